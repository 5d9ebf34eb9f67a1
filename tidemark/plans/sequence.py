"""What follows what in an access trace: successor tables, co-occurrence, runs, hot objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.operators.slices import HALO, SLICE, lagged, prefix, row_halo
from tidemark.plans.study import split_and_pooled
from tidemark.session import materialize


def reads(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("op") == "get").select("app", "ts_ns", "op_id", "object_id")


def steps(trace: DataFrame, order: int = 1) -> DataFrame:
    """Every read with its context: the previous ``order`` objects of the same stream."""
    past = lagged(reads(trace), ["app"], "ts_ns", {f"_p{i}": ("object_id", i) for i in range(order, 0, -1)}, ties=("op_id",))
    names = [f"_p{i}" for i in range(order, 0, -1)]
    return past.where(F.col(names[0]).isNotNull()).select(
        "app", "ts_ns", "op_id", F.concat_ws("\x1f", *names).alias("context"), F.col("object_id").alias("next")
    )


def transitions(trace: DataFrame, order: int = 1, k: int = 4) -> DataFrame:
    """Top-k successors per context with count, confidence and rank.

    The totals are a second aggregation of the counted pairs; the rank filter becomes a
    per-task limit, so a context with many successors ships only its best.
    """
    pairs = steps(trace, order).groupBy("app", "context", "next").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("app", "context").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("app", "context").orderBy(F.desc("n"), "next")
    best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(totals, ["app", "context"]).select(
        "app", "context", "next", "n", "rank", (F.col("n") / F.col("total")).alias("confidence"), (F.col("total") >= 2).alias("supported")
    )


def cooccurrence(trace: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Unordered pairs of objects read within a fixed number of accesses of each other.

    Only the few accesses before each read are looked at, never all pairs of a group.
    """
    n = cfg.cooccurrence_window
    h = row_halo(reads(trace), ["app"], "ts_ns", ties=("op_id",), before=n)
    w = Window.partitionBy("app", SLICE).orderBy("ts_ns", "op_id").rowsBetween(-n, -1)
    return (
        h.withColumn("recent", F.collect_set("object_id").over(w))
        .where(~F.col(HALO))
        .select("app", "object_id", F.explode(F.array_remove("recent", F.col("object_id"))).alias("other"))
        .select("app", F.least("object_id", "other").alias("a"), F.greatest("object_id", "other").alias("b"))
        .groupBy("app", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sequential_runs(ranges: DataFrame) -> DataFrame:
    """Lengths of runs reading block n, then n + 1, of one object, from its reads as ranges of blocks (``study.block_ranges``)."""
    b = ranges.where(F.col("op") == "get").select("app", "ts_ns", "op_id", F.col("object_id").alias("base"), "b0", "b1")
    prev = lagged(b, ["app", "base"], "ts_ns", {"prev": ("b1", 1)}, ties=("op_id", "b0"))
    broken = F.coalesce(F.col("b0") != F.col("prev") + 1, F.lit(True)).cast("int")
    runs = prefix(prev, ["app", "base"], "ts_ns", {"run": ("sum", broken)}, ties=("op_id", "b0"))
    return runs.groupBy("app", "base", "run").agg(F.sum(F.col("b1") - F.col("b0") + 1).alias("length"), F.min("b0").alias("first_block"))


def hot_objects(trace: DataFrame, k: int = 10, pool: bool = False) -> DataFrame:
    """Per app the k objects read most; ``pool`` adds those of all apps together, from the counts per app."""
    w = Window.partitionBy("app").orderBy(F.desc("n"), "object_id")
    counted = reads(trace).groupBy("app", "object_id").agg(F.count(F.lit(1)).alias("n"))
    if pool:
        counted = split_and_pooled(counted).groupBy("app", "object_id").agg(F.sum("n").alias("n"))
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def predictability(trace: DataFrame, order: int = 1, k: int = 4) -> DataFrame:
    """Per app the share of reads that were among the k likeliest successors seen strictly before.

    A successor with v earlier arrivals is beaten by those that reached v + 1 first and by
    smaller ids still at v. Arrivals are numbered per (context, next); the first beats are a
    rank among the arrivals at level v + 1, so only the first k of every level stay candidates,
    and the second are a join of level v to at most k candidates.
    """
    st = steps(trace, order)
    seen = prefix(st, ["app", "context", "next"], "ts_ns", {"level": ("sum", F.lit(1))}, ties=("op_id",)).select(
        "app", "context", "next", "ts_ns", "op_id", "level"
    )
    seen = materialize(seen, "arrivals")
    w = Window.partitionBy("app", "context", "level").orderBy("ts_ns", "op_id")
    cand = (
        seen.where(F.col("level") >= 2).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        .select("app", "context", (F.col("level") - 1).alias("level"), F.col("next").alias("c_next"), F.struct("ts_ns", "op_id").alias("c_at"), (F.col("r") - 1).alias("above"))
    )
    at = F.struct("ts_ns", "op_id")
    # smaller ids that reached this level before the read ...
    level = seen.join(cand, ["app", "context", "level"]).where((F.col("next") < F.col("c_next")) & (at < F.col("c_at")))
    lower = level.groupBy("app", "context", "level", "c_next", "c_at").agg(F.count(F.lit(1)).alias("lower"))
    # ... and have not moved on to the next level
    up = seen.withColumn("level", F.col("level") - 1).join(cand, ["app", "context", "level"]).where(
        (F.col("next") < F.col("c_next")) & (at < F.col("c_at"))
    )
    moved = up.groupBy("app", "context", "level", "c_next", "c_at").agg(F.count(F.lit(1)).alias("moved"))
    key = ["app", "context", "level", "c_next", "c_at"]
    beaten = F.col("above") + F.coalesce("lower", F.lit(0)) - F.coalesce("moved", F.lit(0))
    hits = cand.join(lower, key, "left").join(moved, key, "left").where(beaten < k).groupBy("app").agg(F.count(F.lit(1)).alias("predicted"))
    return seen.groupBy("app").agg(F.count(F.lit(1)).alias("steps")).join(hits, "app", "left").select(
        "app", "steps", F.coalesce("predicted", F.lit(0)).alias("predicted"), (F.coalesce("predicted", F.lit(0)) / F.col("steps")).alias("share")
    )
