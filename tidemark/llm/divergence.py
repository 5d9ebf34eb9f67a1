"""How far sources of one language differ in their words, and by which words.

A task blanks a text's separators and lowers its letters with one ``bytes.translate``, splits it with ``bytes.split``
and counts it with a ``Counter``. What it sends on are sparse counts of (language, source, term), added up
over its documents, so a hot source is a few rows a task. The counts stay sparse: a term that a source lacks has that
source's base share, and pairs of sources are compared in blocks of sources and slices of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Every byte lower-cased if it is a letter A-Z, and a blank if it is ASCII and no letter.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text split at once; bytes a task gathers before it sends them on, and those of an entry beside its term.
PIECE_BYTES = 1 << 20
GATHERED_BYTES = 96 << 20
ENTRY_BYTES = 250
#: Sources of a block and rows of a slice, when pairs of sources are compared; terms of a dense strip.
BLOCK = 128
SLICE_ROWS = 500_000
STRIP = 2048
#: Shares are counted in units of one to this.
UNITS = 1_000_000_000


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of a whole text; a long one is split in pieces that end between terms."""
    found: Counter = Counter()
    blanked = text.translate(WORD_BYTES)
    start = 0
    while start < len(blanked):
        end = blanked.find(b" ", start + PIECE_BYTES)
        end = len(blanked) if end < 0 else end
        found.update(blanked[start:end].split())
        start = end
    return found


def _batch(gathered: dict[tuple[str, str], dict[bytes, list[int]]]) -> pa.RecordBatch:
    lang, source, term, numbers = [], [], [], []
    for group, found in gathered.items():
        lang += [group[0]] * len(found)
        source += [group[1]] * len(found)
        term += found.keys()
        numbers += found.values()
    n, docs = (pa.array([x[k] for x in numbers], pa.int64()) for k in (0, 1))
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), n, docs]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences in the task's documents, and how many of these hold the term."""
    gathered: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            into = gathered.setdefault((lang, source), {})
            for term, n in term_counts(text.as_py()).items():
                if (entry := into.get(term)) is None:
                    into[term] = [n, 1]
                    held += len(term) + ENTRY_BYTES
                else:
                    entry[0] += n
                    entry[1] += 1
            if held >= GATHERED_BYTES:
                yield _batch(gathered)
                gathered, held = {}, 0
    if held:
        yield _batch(gathered)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (n + 5) / (total + 5 * terms)), in whole numbers of any size; null without terms."""
    over = F.lit(UNITS).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", over, (total + 5 * terms).cast("decimal(20,0)")) + 1).cast("long")


def _compare(block: int, strip_terms: int = STRIP) -> Callable[[pa.Table], pa.Table]:
    """(lang, i, j, value) of all pairs of the sources of two blocks, over the terms of a slice.

    Rows without a term name the sources and their base shares. A term that none of them holds differs by the bases
    alone, so terms are added up as what they differ by beyond the bases, and slice 0 adds the bases for all terms.
    """

    def compare(rows: pa.Table) -> pa.Table:
        named = rows.filter(pc.is_null(rows["term"]))
        rows = rows.filter(pc.is_valid(rows["term"]))
        order = np.argsort(named["idx"].to_numpy())
        sources = named["idx"].to_numpy()[order]
        base = named["base"].fill_null(0).to_numpy()[order]
        at = np.searchsorted(sources, rows["idx"].to_numpy())
        code = np.asarray(rows["term"].combine_chunks().dictionary_encode().indices) if len(rows) else np.zeros(0, np.int32)
        by_term = np.argsort(code, kind="stable")
        code, at, share = code[by_term], at[by_term], rows["p"].to_numpy()[by_term]
        terms = int(code[-1]) + 1 if len(code) else 0
        first, last = (int(named[c][0].as_py()) for c in ("x", "y"))
        one, two = (np.flatnonzero(sources // block == k) for k in (first, last))
        apart = np.abs(base[one][:, None] - base[two][None, :])
        total = apart * ((int(named["v"][0].as_py()) if named["slice"][0].as_py() == 0 else 0) - terms)
        edges = np.searchsorted(code, np.arange(0, terms + strip_terms, strip_terms))
        for k, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            strip = np.tile(base, (min(strip_terms, terms - k * strip_terms), 1))
            strip[code[low:high] - k * strip_terms, at[low:high]] = share[low:high]
            for row, i in enumerate(one.tolist()):
                total[row] += np.abs(strip[:, i, None] - strip[:, two]).sum(axis=0)
        left, right = np.repeat(sources[one], len(two)), np.tile(sources[two], len(one))
        keep = left < right if first == last else left != right
        left, right, value = left[keep], right[keep], total.ravel()[keep]
        lang = pa.array([named["lang"][0].as_py()] * (2 * len(value)), pa.string())
        return pa.table({"lang": lang, "i": np.concatenate([left, right]), "j": np.concatenate([right, left]), "value": np.concatenate([value, value])})

    return compare


def _pairs(shares: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    cols = ("lang", "slice", "last_block", "idx", "term", "p", "base", "v")
    entries = shares.withColumn("slice", F.pmod(F.xxhash64("term"), "slices")).select(*cols)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    named = groups.select("*", every.alias("slice"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p")).select(*cols)
    own = F.floor(F.col("idx") / block)
    sent = entries.unionByName(named).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last_block")))
    sent = sent.select("lang", F.least(own, "other").alias("x"), F.greatest(own, "other").alias("y"), "slice", "idx", "term", "p", "base", "v")
    compared = sent.groupBy("lang", "x", "y", "slice").applyInArrow(_compare(block), "lang string, i long, j long, value long")
    summed = compared.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    one = groups.select("lang", F.col("idx").alias("i"), "source")
    two = groups.select("lang", F.col("idx").alias("j"), F.col("source").alias("item"))
    return summed.join(one, ["lang", "i"]).join(two, ["lang", "j"]).select("lang", "source", "item", "value")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top: int = 50, block: int = BLOCK, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    * Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that
      stand in ``least_docs`` of its documents. A group (a source in a language) and a language give each kept term the share
      1 + floor(10^9 (n + 5) / (N + 5 V)) of its occurrences n there, of all its occurrences N of the V kept terms.
    * Part ``pair``: every other source of the language, with the absolute differences of the shares summed over
      all kept terms; 0 if there are none. Part ``term``: the kept terms that the group holds with a larger share than
      its language has, with the difference; the ``top`` largest of a group. Ranks count from 1, by value descending, ties by item.
    * Null text, language and source are empty ones; empty is a language or source like any other. Repeated rows count
      as often as they stand. Groups without terms have pairs; a language's only source has none. Other columns are not read. No rows give no rows.
    """
    rows = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.min("source").alias("least")).filter(F.col("docs") >= least_docs).drop("docs")
    sparse = materialize(counts.drop("docs").join(kept, ["lang", "term"]).withColumn("least", F.col("source") == F.col("least")), "kept_terms")
    # Small tables: a row a group, a row a language. A term is counted where its first source is.
    of_group = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"), F.count_if("least").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").fillna(0, ["total", "entries", "terms"])
    whole = Window.partitionBy("lang")
    place = F.row_number().over(whole.orderBy("source")) - 1
    groups = groups.select("lang", "source", "total", F.sum("terms").over(whole).alias("v"), F.sum("total").over(whole).alias("lang_total"), F.sum("entries").over(whole).alias("entries"), place.cast("long").alias("idx"))
    slices, last_block = F.greatest(F.lit(1), F.ceil(F.col("entries") / slice_rows)), F.floor(F.max("idx").over(whole) / block)
    groups = materialize(groups.select("*", slices.alias("slices"), last_block.alias("last_block"), _share(F.lit(0), F.col("total"), F.col("v")).alias("base")), "groups")
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    shares = sparse.join(groups, ["lang", "source"]).select("lang", "source", "term", "idx", "base", "v", "slices", "last_block", p.alias("p"), q.alias("q"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.select("*", place.alias("rank")).filter(F.col("rank") <= top)
    pairs = _pairs(shares, groups, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", place.alias("rank"))
    return pairs.unionByName(terms)
