"""Summaries of a stream that add up: distinct sockets, hot objects and the scorecard, from what each pane or micro-batch left behind.

Nothing here looks at a record twice. A micro-batch (or pane of time) leaves counts and sketches, keyed so that a
retried one replaces its own; answers are merged from these, whose number depends on time and not on the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.plans import scorecard as SC
from tidemark.plans.scorecard import KEYS
from tidemark.streaming.windows import RANK_SKETCH, drain, event_time
from tidemark.session import scratch_path

#: Distinct values a theta sketch holds exactly (2^12); beyond, estimates are off by about 1 / sqrt of it (1.6 %, one standard deviation).
THETA_LOG = 12


def collect_parts(stream: DataFrame, name: str, summarise) -> DataFrame:
    """Drain the stream and return what ``summarise`` makes of each micro-batch, with its ``batch``; no record is stored."""
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    schema = summarise(spark.createDataFrame([], stream.schema)).schema
    drain(stream, path, log, keep=summarise)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return spark.read.schema(schema.add("batch", "integer")).parquet(path)


# -- distinct sockets ---------------------------------------------------------------------


def _theta(function: str, *args: Column | str) -> Column:
    return F.call_function(f"theta_{function}", *args)


def socket_panes(records: DataFrame, pane: str = "1 day", late_by: str = "1 hour", log: int = THETA_LOG) -> DataFrame:
    """Per pane of time the records and a theta sketch of their sockets."""
    return (
        event_time(records, late_by)
        .groupBy(F.window("at", pane).alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), _theta("sketch_agg", "sock_cookie", F.lit(log)).alias("sketch"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "records", "sketch")
    )


def socket_movement(panes: DataFrame, memory: int, log: int = THETA_LOG) -> DataFrame:
    """Per pane its distinct sockets, those also seen in one of the ``memory`` panes before, those not, and the distinct sockets of all these panes.

    A pane's sketch goes to the panes that remember it, and is merged there; so no sketch is merged with all earlier ones.
    """
    step = F.col("end_us") - F.col("start_us")
    later = F.sequence(F.col("start_us") + step, F.col("start_us") + memory * step, step)
    before = (
        panes.select(F.explode(later).alias("start_us"), "sketch").groupBy("start_us").agg(_theta("union_agg", "sketch", F.lit(log)).alias("before"))
    )
    size = lambda c: _theta("sketch_estimate", c)
    own, old = F.col("sketch"), F.col("before")
    return panes.join(before, "start_us", "left").select(
        "start_us",
        "records",
        size(own).alias("sockets"),
        F.when(old.isNull(), F.lit(0)).otherwise(size(_theta("intersection", own, old))).cast("bigint").alias("returned"),
        F.when(old.isNull(), size(own)).otherwise(size(_theta("difference", own, old))).alias("fresh"),
        F.when(old.isNull(), size(own)).otherwise(size(_theta("union", own, old, F.lit(log)))).alias("sockets_in_memory"),
    )


# -- hot objects --------------------------------------------------------------------------


def tracked(share: float) -> int:
    """How many objects a sketch must track so that none with ``share`` of the reads is missed: its count errs by 3.5 of as many parts."""
    return max(1000, round(16 / share))


def object_parts(trace: DataFrame, share: float) -> DataFrame:
    """Of one micro-batch, per application: reads, and a sketch of the objects read most."""
    # the counter merges its partial sketches task by task, so a hot application sends one sketch a task
    return trace.where(F.col("op") == "get").groupBy("app").agg(
        F.count(F.lit(1)).alias("reads"), F.call_function("approx_top_k_accumulate", "object_id", F.lit(tracked(share))).alias("sketch")
    )


def hot_objects(parts: DataFrame, share: float) -> DataFrame:
    """Per application every object with at least ``share`` of its reads so far: exact while the sketch tracks all objects, else each
    with a count that is at most 22 % of ``share`` off. At most 1 / share objects can qualify, so the list is bounded."""
    merged = parts.groupBy("app").agg(F.sum("reads").alias("total"), F.call_function("approx_top_k_combine", "sketch", F.lit(tracked(share))).alias("sketch"))
    top = F.call_function("approx_top_k_estimate", "sketch", F.lit(int(1 / share) + 1))
    found = merged.select("app", "total", F.explode(top).alias("x")).select("app", F.col("x.item").alias("object_id"), F.col("x.count").alias("n"), "total")
    return found.where(F.col("n") >= share * F.col("total"))


# -- the scorecard without a second look ---------------------------------------------------

# Inclusive ranks. The second is the least above the middle that a sketch tells from it, so the two are the middle values, equal when the count is odd.
_RANKS = (0.5, 0.5 + 1e-6, 0.95, 0.99)


def scorecard_parts(ops: DataFrame, k: int = RANK_SKETCH) -> DataFrame:
    """Of one micro-batch, per (bucket, operation, status): counts, the time span, and rank sketches of latency and throughput."""
    timed = C.timeable()
    tput = (F.col("s3_op") == "GetObject") & (F.col("download_ns") > 0)
    return (
        ops.withColumn("bucket", C.sanitize_term(F.col("bucket")))
        .withColumn("s3_op", C.sanitize_term(F.col("s3_op")))
        .groupBy(*KEYS, "http_status")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("ts_start"), F.max("ts_ns").alias("ts_end"),
            F.count(F.when(timed, F.col("ttfb_ns"))).alias("n_ttfb"), F.count(F.when(timed & tput, F.col("content_length"))).alias("n_tput"),
            F.call_function("kll_sketch_agg_bigint", F.when(timed, F.col("ttfb_ns")), F.lit(k)).alias("ttfb"),
            F.call_function("kll_sketch_agg_double", F.when(timed & tput, F.col("content_length") / F.col("download_ns") * 1e9), F.lit(k)).alias("tput"),
        )
    )


def merged_scorecard(parts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``plans.scorecard.scorecard`` of everything the parts were made of, from the parts alone.

    Counts are exact. Percentiles are exact while a group has no more values than a sketch holds, then off by about a thousandth of the ranks.
    """
    statuses = parts.groupBy(*KEYS, "http_status").agg(
        F.sum("n").alias("n"), F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"), F.sum("n_ttfb").alias("n_ttfb"), F.sum("n_tput").alias("n_tput"),
        F.call_function("kll_merge_agg_bigint", "ttfb").alias("ttfb"), F.call_function("kll_merge_agg_double", "tput").alias("tput"),
    )
    answered = F.col("http_status").isNotNull()
    groups = statuses.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(answered, F.col("n"))), F.lit(0)).alias("ops"),
        F.sum("n").alias("group_total"),
        F.coalesce(F.sum(F.when(F.col("http_status") >= 400, F.col("n"))), F.lit(0)).alias("errors"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(answered, F.struct("http_status", "n"))))).alias("status_counts"),
        F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"), F.sum("n_ttfb").alias("latency_sample"), F.sum("n_tput").alias("n_tput"),
        F.call_function("kll_merge_agg_bigint", "ttfb").alias("ttfb"), F.call_function("kll_merge_agg_double", "tput").alias("tput"),
    ).where(F.col("ops") > 0)
    n, ranks = F.col("latency_sample"), F.array(*map(F.lit, _RANKS))
    ranked = groups.withColumn("q", F.when(n > 0, F.call_function("kll_sketch_get_quantile_bigint", "ttfb", ranks))).withColumn(
        "t", F.when(F.col("n_tput") > 0, F.call_function("kll_sketch_get_quantile_double", "tput", ranks))
    )
    q = lambda i: F.get("q", F.lit(i))
    mid = lambda c: (F.get(c, F.lit(0)) + F.get(c, F.lit(1))) / 2.0
    return ranked.select(
        *KEYS, "ops", "errors", (F.col("errors") / F.col("ops")).alias("error_rate"), "status_counts",
        SC.whole(mid("q")).alias("ttfb_p50_ns"),
        F.when(n >= cfg.min_tail_sample, q(2)).alias("ttfb_p95_ns"),
        F.when(n >= cfg.min_p99_sample, q(3)).alias("ttfb_p99_ns"),
        "latency_sample",
        F.when(F.col("s3_op") == "GetObject", mid("t")).alias("throughput_bytes_per_s"),
        "ts_start", "ts_end", "group_total",
        F.when(n >= cfg.min_p99_sample, q(3) / F.when(mid("q") > 0, mid("q"))).alias("p99_over_p50"),
    )
