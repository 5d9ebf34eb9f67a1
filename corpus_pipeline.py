"""A training corpus from raw documents: five stages, each an operator of ``tidemark.llm``.

Each stage takes what the one before it kept and returns the columns of ``documents``; the last returns tokens.
Stages are written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
Null, empty and repeated rows pass through every stage as its operator's docstring says; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, langid, lines, mixing
from tidemark.llm.learn import fold
from tidemark.llm.text import small_batches
from tidemark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date with the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null ``lang`` is filled in. Without a letter, or below the calibrated score, they go."""
    small_batches(spark)
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = docs.withColumn("_p", langid.predict("text", model)).filter("_p.accepted")
    return found.withColumn("lang", F.coalesce("lang", F.col("_p.lang"))).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that stand in an earlier one; a document of which nothing is left goes."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    return _documents(out.filter((F.col("removed_chunks") == 0) | (F.trim("text") != "")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.75 or more: the one with the smallest id."""
    small_batches(spark)
    return jaccard.deduplicate(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, as often as the mixture takes them; the last one of a source's target is cut at a word."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    return _documents(mixing.arrange(mixing.plan_mixture(sized)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as a digest."""
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = docs.select("doc_id", "lang", "source", bpe.encode("text", path, docs).alias("ids"))
    return ids.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.encode(bpe.decode("ids", path, docs), "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: A trained stage cannot be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
