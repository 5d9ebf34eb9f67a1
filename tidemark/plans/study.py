"""The study of an access trace: reuse, working set and sizing.

Traces have app, ts_ns, op_id, op, object_id, size, status; ``app`` is '*' for the pooled
stream. No cache is replayed: reuse is what a cache that never evicts would hit, an upper bound for any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.operators.slices import SLICE, lagged, prefix
from tidemark.session import materialize

ALL = "*"


def pooled(trace: DataFrame) -> DataFrame:
    return trace.withColumn("app", F.lit(ALL))


def split_and_pooled(trace: DataFrame) -> DataFrame:
    """Every access once under its application and once under the pooled stream."""
    return trace.withColumn("app", F.explode(F.array(F.col("app").cast("string"), F.lit(ALL))))


def _ranged() -> Column:
    return F.coalesce(F.col("status") == 206, F.lit(False))


def whole_get() -> Column:
    return (F.col("op") == "get") & ~_ranged()


def summary(trace: DataFrame, pool: bool = False) -> DataFrame:
    """Per app: events, reads, distinct objects, ranged share and size coverage.

    ``pool`` adds the row of all apps together, from the counts per (app, object): the accesses are read and shuffled once.
    """
    has_range = F.col("range_start").isNotNull() if "range_start" in trace.columns else F.lit(False)
    per_object = trace.groupBy("app", "object_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("op") == "get").alias("gets"),
        F.count_if(whole_get()).alias("whole"),
        F.count_if(whole_get() & F.col("size").isNotNull()).alias("sized"),
        F.count_if(_ranged() & (F.col("op") != "get")).alias("ranged_excluded"),
        F.count_if(_ranged() & ~has_range).alias("unplaceable"),
        F.count_if((F.col("op") == "get") | _ranged()).alias("body"),
        F.min("ts_ns").alias("ts_start"), F.max("ts_ns").alias("ts_end"),
    )
    s = lambda c: F.sum(c).alias(c)
    counts = ("events", "gets", "whole", "sized", "ranged_excluded", "unplaceable", "body")
    if pool:
        both = split_and_pooled(per_object).groupBy("app", "object_id")
        per_object = both.agg(*[s(c) for c in counts], F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"))
    return per_object.groupBy("app").agg(
        *[s(c) for c in counts],
        F.count_if(F.col("gets") > 0).alias("objects"),
        F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"),
    ).select(
        "app", "events", "gets", "objects", "ranged_excluded",
        F.when(F.col("body") > 0, F.col("unplaceable") / F.col("body")).otherwise(F.lit(0.0)).alias("ranged_frac"),
        F.when(F.col("whole") > 0, F.col("sized") / F.col("whole")).otherwise(F.lit(0.0)).alias("size_coverage"),
        "ts_start", "ts_end",
    )


def resident_hits(trace: DataFrame) -> DataFrame:
    """Per app the reads, and those of an object that was read before and not written since: the hits of a
    cache that never evicts, so the most that any cache which writes invalidate can reach."""
    ev = trace.where(F.col("op").isin("get", "put", "delete")).select("app", "object_id", "ts_ns", "op_id", "op")
    prev = lagged(ev, ["app", "object_id"], "ts_ns", {"prev_op": ("op", 1)}, ties=("op_id",))
    reads = F.col("op") == "get"
    return prev.groupBy("app").agg(
        F.count_if(reads).alias("accesses"),
        F.count_if(reads & F.coalesce(F.col("prev_op") == "get", F.lit(False))).alias("resident_hits"),
    ).withColumn("ceiling", F.when(F.col("accesses") > 0, F.col("resident_hits") / F.col("accesses")))


def object_sizes(trace: DataFrame) -> DataFrame:
    """(app, object_id, size): the latest observed size; NULL when none was."""
    return trace.where(whole_get()).groupBy("app", "object_id").agg(
        F.max_by("size", F.when(F.col("size").isNotNull(), F.struct("ts_ns", "op_id"))).alias("size")
    )


def byte_sizing(trace: DataFrame) -> DataFrame:
    """Per app: distinct objects, the median fill for unsized ones and the working set."""
    sizes = object_sizes(trace)
    med = exact_quantiles(sizes, ["app"], {"s": F.col("size")}, [Stat("m", "s", "upper")]).select(
        "app", F.greatest(F.col("m").cast("bigint"), F.lit(1)).alias("fill")
    )
    tot = sizes.groupBy("app").agg(
        F.count(F.lit(1)).alias("objects"), F.count("size").alias("sized"), F.coalesce(F.sum("size"), F.lit(0)).alias("known")
    )
    return tot.join(med, "app").select(
        "app", "objects", "sized", "fill", (F.col("known") + (F.col("objects") - F.col("sized")) * F.col("fill")).alias("total_bytes")
    )


def block_ranges(trace: DataFrame, block_bytes: int) -> DataFrame:
    """Reads and writes of objects as accesses of ranges b0..b1 of fixed-size blocks, each block of an access in one range.

    A read covers the blocks of its extent. A write covers its own and every block read since the previous
    write of the object: it shares their write epoch, whose ranges are merged along the block axis. So a
    read of any length is one row, and no block is named.
    """
    has = set(trace.columns)
    a = F.coalesce(F.col("range_start"), F.lit(0)) if "range_start" in has else F.lit(0)
    size_end = F.when(F.col("size") > 0, F.col("size") - 1).otherwise(0)
    b = F.coalesce(F.col("range_end"), size_end) if "range_end" in has else size_end
    ev = trace.where(F.col("op").isin("get", "put", "delete")).select(
        "app", "ts_ns", "op_id", "op", "object_id", "status",
        F.floor(F.least(a, b) / block_bytes).cast("bigint").alias("b0"), F.floor(F.greatest(a, b) / block_bytes).cast("bigint").alias("b1"),
    )
    is_write = F.col("op") != "get"
    ev = prefix(ev, ["app", "object_id"], "ts_ns", {"epoch": ("sum", is_write.cast("int"))}, ties=("op_id",), frame="rows_before").drop(SLICE)
    ev = materialize(ev, "accesses")
    epoch = ["app", "object_id", "epoch"]
    swept = materialize(ev.select(*epoch, "b0", "b1").distinct(), "swept")
    reach = prefix(swept, epoch, "b0", {"reach": ("max", F.col("b1"))}, ties=("b1",), frame="rows_before")
    apart = F.coalesce(F.col("b0") > F.col("reach") + 1, F.lit(True))
    merged = prefix(reach, epoch, "b0", {"part": ("sum", apart.cast("int"))}, ties=("b1",)).groupBy(*epoch, "part").agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    wrote = ev.where(is_write).drop("b0", "b1").join(merged, epoch)
    cols = ["app", "ts_ns", "op_id", "op", "object_id", "status", "b0", "b1"]
    return ev.where(~is_write).select(cols).unionByName(wrote.select(cols))


#: Blocks that one row of a range is expanded to at once.
EXPANDED = 4096


def to_blocks(trace: DataFrame, block_bytes: int) -> DataFrame:
    """``block_ranges`` block by block, as accesses of ``id#n``.

    A long range is first cut into pieces, which are dealt out, so neither a row nor a task holds all its blocks.
    """
    ranges = materialize(block_ranges(trace, block_bytes), "block-ranges")
    short = F.col("b1") - F.col("b0") < EXPANDED
    pieces = ranges.where(~short).withColumn("_piece", F.explode(F.sequence(F.expr(f"b0 div {EXPANDED}L"), F.expr(f"b1 div {EXPANDED}L")))).repartition("object_id", "_piece")
    begin = F.col("_piece") * EXPANDED
    cut = pieces.withColumn("b0", F.greatest("b0", begin)).withColumn("b1", F.least("b1", begin + EXPANDED - 1)).drop("_piece")
    blocks = ranges.where(short).unionByName(cut).withColumn("block", F.explode(F.sequence("b0", "b1")))
    return blocks.select(
        "app", "ts_ns", "op_id", "op", F.concat("object_id", F.lit("#"), F.col("block").cast("string")).alias("object_id"), "status", F.lit(None).cast("bigint").alias("size")
    )


def next_use(trace: DataFrame) -> DataFrame:
    """Per read the time of the object's next read, NULL if a write comes first or none follows."""
    ev = trace.where(F.col("op").isin("get", "put", "delete")).select("app", "object_id", "ts_ns", "op_id", "op")
    nxt = lagged(ev, ["app", "object_id"], "ts_ns", {"next_op": ("op", -1), "next_ts": ("ts_ns", -1)}, ties=("op_id",))
    return nxt.where(F.col("op") == "get").select(
        "app", "object_id", "op_id", "ts_ns", F.when(F.col("next_op") == "get", F.col("next_ts")).alias("next_use")
    )
