"""Line dedup by content-defined chunks of lines.

A rolling hash over two lines decides whether a chunk of lines ends between them, so a passage that moved inside a document,
or into another one, is cut at the same places again. What is compared is a *unit*: a chunk of several lines, a seam (the
two lines at a cut), or a long line. Chunks alone would miss a passage's edges, where they run on into other
lines; seams join what chunks cut, so that of a repeated passage nearly every pair of lines is in some unit.
Units whose hash occurs more than once in all documents are compared byte by byte, and the lines of all but
the first occurrence are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

BASE = 31
_UNIT = "array<struct<start:int,stop:int,hash:bigint>>"


def units(text: str, divisor: int, min_chars: int, long_line: int) -> Iterator[tuple[int, int, int]]:
    """(first line, last line, hash) of the text's units, in one pass.

    A chunk ends between two lines if their rolling hash is not 0 modulo ``divisor``, or if they are equal.
    """
    lines = text.split("\n")
    digests = [md5(line.encode("utf-8", "surrogatepass")).digest() for line in lines]
    sizes = [len(line) for line in lines]

    def unit(start: int, stop: int) -> tuple[int, int, int]:
        return start, stop, int.from_bytes(md5(b"".join(digests[start : stop + 1])).digest()[:8], "little", signed=True)

    begin = before = 0
    for i, digest in enumerate(digests):
        h = int.from_bytes(digest[:3], "big")
        if sizes[i] >= long_line:
            yield unit(i, i)
        if i and ((h + BASE * before) % divisor or h == before):
            if sizes[i - 1] + 1 + sizes[i] >= min_chars:
                yield unit(i - 1, i)
            if i - begin > 1 and sum(sizes[begin:i]) + i - begin - 1 >= min_chars:
                yield unit(begin, i - 1)
            begin = i
        before = h
    if len(lines) - begin > 1 and sum(sizes[begin:]) + len(lines) - begin - 1 >= min_chars:
        yield unit(begin, len(lines) - 1)


def _units_of(text: Column, divisor: int, min_chars: int, long_line: int) -> Column:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())]))

    @F.arrow_udf(_UNIT)
    def found(column: pa.Array) -> pa.Array:
        starts, stops, hashes, ends = [], [], [], [0]
        for scalar in column:
            value = scalar.as_py()
            for start, stop, h in units(value, divisor, min_chars, long_line) if value is not None else ():
                starts.append(start)
                stops.append(stop)
                hashes.append(h)
            ends.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(hashes, pa.int64())], names=["start", "stop", "hash"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows).cast(kind)

    return found(text)


def _fetched(text: Column, spans: Column) -> Column:
    """The given units with their texts; a text is split once, however many of its units are asked for."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64()), ("unit", pa.string())]))

    @F.arrow_udf("array<struct<start:int,stop:int,hash:bigint,unit:string>>")
    def read(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, some in zip(texts.to_pylist(), wanted, strict=True):
            rows = t.split("\n")
            out.append([{**s, "unit": "\n".join(rows[s["start"] : s["stop"] + 1])} for s in some.as_py()])
        return pa.array(out, kind)

    return read(text, spans)


def _cut(text: Column, gone: Column) -> Column:
    """The text without the lines of the given numbers; null stays null."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, drop in zip(texts.to_pylist(), numbers, strict=True):
            drop = set() if t is None else set(drop.as_py())
            out.append(None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
        return pa.array(out, pa.string())

    return kept(text, gone)


def _later(doubtful: DataFrame, place: Column) -> DataFrame:
    """The doubtful units that stand earlier too, byte by byte.

    All units of a hash are equal if the least and the greatest of their texts are, which each task finds out for
    its own first; then texts need not meet. Only units of a hash that different texts share are grouped by text.
    """
    seen = doubtful.groupBy("hash").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("k"), (F.min("unit") == F.max("unit")).alias("equal"))
    seen = materialize(seen.filter("k > 1"), "unit_hashes")
    cols = ["__llm_key", "__llm_row", "start", "stop"]
    alike = doubtful.drop("unit").join(seen.filter("equal").select("hash", "keep"), "hash").filter(place != F.col("keep")).select(*cols)
    mixed = doubtful.join(seen.filter("NOT equal").select("hash"), "hash", "left_semi")
    firsts = mixed.groupBy("unit").agg(F.min(place).alias("keep"))
    return alike.unionByName(mixed.join(firsts, "unit").filter(place != F.col("keep")).select(*cols))


def dedup_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    divisor: int = 8,
    min_chars: int = 20,
    long_line: int = 120,
) -> DataFrame:
    """All rows and columns of ``df``, the text without repeated lines, with n_lines, removed_chunks (units), removed_lines.

    * Units are chunks of several lines and seams, of ``min_chars`` characters or more, and lines of ``long_line`` characters
      or more. A line is removed if it lies in a unit that stands earlier too: at a smaller key (null last), or further up
      in the same document. So of all equal lines the first is never removed, and short lines that merely recur stay.
    * A passage of k repeated lines is found unless none of its k - 1 pairs is a seam (each fails with a chance of 1 / ``divisor``)
      and the chunk around it differs; an edge line may stay where its pair is no seam.
    * Rows that agree in key and text are one document and get the same result. Of rows with the same key and
      different texts, the smaller text digest is the earlier one.
    * Null text stays null and has no lines. An empty text is one empty line. A text of which nothing
      is left becomes empty.
    * Columns of ``df`` with one of the new names are replaced. No rows give no rows.
    """
    base = df.drop("n_lines", "removed_chunks", "removed_lines").withColumn("__llm_digest", F.coalesce(F.md5(F.col(text)), F.lit("")))
    row = [F.col(key).alias("__llm_key"), F.col("__llm_digest").alias("__llm_row")]
    found = materialize(base.select(*row, F.explode(_units_of(F.col(text), divisor, min_chars, long_line)).alias("u")).select("__llm_key", "__llm_row", "u.*"), "units")
    # Units of a hash that occurs once need no text: only the others are fetched and compared.
    repeated = found.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("hash")
    suspects = found.join(repeated, "hash", "left_semi").groupBy("__llm_key", "__llm_row").agg(F.collect_set(F.struct("start", "stop", "hash")).alias("__llm_suspects"))
    same_row = F.col(key).eqNullSafe(F.col("__llm_key")) & (F.col("__llm_digest") == F.col("__llm_row"))
    lines = F.split(F.col(text), "\n")

    fetched = base.join(suspects, same_row).select("__llm_key", "__llm_row", F.explode(_fetched(F.col(text), F.col("__llm_suspects"))).alias("u"))
    doubtful = materialize(fetched.select("__llm_key", "__llm_row", "u.*"), "suspects")
    place = F.struct(F.col("__llm_key").isNull().alias("nil"), F.col("__llm_key").alias("key"), F.col("__llm_row").alias("row"), F.col("start").alias("start"))
    gone = (
        _later(doubtful, place)
        .groupBy("__llm_key", "__llm_row")
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        .select("__llm_key", "__llm_row", F.size("spans").alias("__llm_units"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.stop)))).alias("__llm_gone"))
    )
    return (
        base.join(gone, same_row, "left")
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("removed_chunks", F.coalesce("__llm_units", F.lit(0)))
        .withColumn("removed_lines", F.coalesce(F.size("__llm_gone"), F.lit(0)))
        .withColumn(text, F.when(F.col("__llm_units").isNull(), F.col(text)).otherwise(_cut(F.when(F.col("__llm_units").isNotNull(), F.col(text)), F.col("__llm_gone"))))
        .drop("__llm_gone", "__llm_units", "__llm_key", "__llm_row", "__llm_digest")
    )
