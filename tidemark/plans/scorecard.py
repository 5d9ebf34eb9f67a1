"""The service level each (bucket, operation) actually saw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.plans import findings as FD

KEYS = ["bucket", "s3_op"]

# Status class -> finding id and domain, in reporting order.
ERROR_FINDINGS = {
    "forbidden": ("scorecard-error-403", "client"),
    "not_found": ("scorecard-error-404", "client"),
    "bad_request": ("scorecard-error-400", "client"),
    "throttle": ("scorecard-throttle", "s3"),
    "server": ("scorecard-server-5xx", "s3"),
    "client": ("scorecard-error-4xx", "client"),
}


def _same_keys(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEYS])


def _grouped(ops: DataFrame) -> DataFrame:
    return ops.withColumn("bucket", C.sanitize_term(F.col("bucket"))).withColumn("s3_op", C.sanitize_term(F.col("s3_op")))


def _status_counts(ops: DataFrame) -> DataFrame:
    """(bucket, s3_op, http_status) counts: the only shuffle the request rows take."""
    return _grouped(ops).groupBy(*KEYS, "http_status").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("ts_start"), F.max("ts_ns").alias("ts_end")
    )


def _latency(ops: DataFrame) -> DataFrame:
    tput = F.when(
        (F.col("s3_op") == "GetObject") & (F.col("download_ns") > 0),
        F.col("content_length") / F.col("download_ns") * 1e9,
    )
    return exact_quantiles(
        _grouped(ops).where(C.timeable()),
        KEYS,
        {"ttfb": F.col("ttfb_ns"), "tput": tput},
        [Stat("p50", "ttfb", "mid"), Stat("p95", "ttfb", 0.95), Stat("p99", "ttfb", 0.99), Stat("tput", "tput", "mid")],
    )


def whole(c: Column) -> Column:
    return F.round(c).cast("bigint")


def scorecard(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows for every group with at least one answered request; NULL keys stay visible."""
    answered = F.col("http_status").isNotNull()
    counts = (
        _status_counts(ops)
        .groupBy(*KEYS)
        .agg(
            F.coalesce(F.sum(F.when(answered, F.col("n"))), F.lit(0)).alias("ops"),
            F.sum("n").alias("group_total"),
            F.coalesce(F.sum(F.when(F.col("http_status") >= 400, F.col("n"))), F.lit(0)).alias("errors"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(answered, F.struct("http_status", "n"))))
            ).alias("status_counts"),
            F.min("ts_start").alias("ts_start"),
            F.max("ts_end").alias("ts_end"),
        )
        .where(F.col("ops") > 0)
    )
    n = F.coalesce(F.col("q.n_ttfb"), F.lit(0))
    return counts.alias("c").join(_latency(ops).alias("q"), _same_keys("c", "q"), "left").select(
        "c.bucket",
        "c.s3_op",
        "ops",
        "errors",
        (F.col("errors") / F.col("ops")).alias("error_rate"),
        "status_counts",
        whole(F.col("q.p50")).alias("ttfb_p50_ns"),
        F.when(n >= cfg.min_tail_sample, whole(F.col("q.p95"))).alias("ttfb_p95_ns"),
        F.when(n >= cfg.min_p99_sample, whole(F.col("q.p99"))).alias("ttfb_p99_ns"),
        n.alias("latency_sample"),
        F.when(F.col("c.s3_op") == "GetObject", F.col("q.tput")).alias("throughput_bytes_per_s"),
        "ts_start",
        "ts_end",
        "group_total",
        F.when(n >= cfg.min_p99_sample, F.col("q.p99") / F.when(F.col("q.p50") > 0, F.col("q.p50"))).alias("p99_over_p50"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Scorecard or class rows by key, null keys last: a range sort, no single task."""
    return rows.orderBy(*[F.col(k).asc_nulls_last() for k in KEYS])


def status_text(c: Column) -> Column:
    """The status map as ``code:count`` pairs."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(c)),
            lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")),
        ),
        ",",
    )


def reliability_findings(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A status class that exceeds its rate on a group with enough answered requests."""
    cls = C.status_class(F.col("http_status"))
    by_class = _status_counts(ops).withColumn("cls", cls)
    totals = by_class.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(F.col("cls").isNotNull(), F.col("n"))), F.lit(0)).alias("n_ops"),
        F.sum("n").alias("group_total"),
        F.min("ts_start").alias("ts_start"),
        F.max("ts_end").alias("ts_end"),
    )
    per = by_class.where(F.col("cls").isin(list(ERROR_FINDINGS))).groupBy(*KEYS, "cls").agg(F.sum("n").alias("count"))
    hot = (
        per.alias("p")
        .join(totals.alias("t"), _same_keys("p", "t"))
        .where(
            (F.col("n_ops") >= cfg.sc_min_ops)
            & (F.col("count") >= cfg.sc_min_errors)
            & (F.col("count") / F.col("n_ops") > cfg.sc_err_rate_floor)
            & (F.col("p.bucket").isNotNull() | F.col("p.s3_op").isNotNull())
        )
        .select("p.bucket", "p.s3_op", "cls", "count", "n_ops", "group_total", "ts_start", "ts_end")
    )
    seen = FD.evidence(
        _grouped(ops).withColumn("cls", cls).where(F.col("cls").isin(list(ERROR_FINDINGS))), [*KEYS, "cls"], cfg.max_evidence
    )
    ident, domain = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, (fid, dom) in ERROR_FINDINGS.items():
        ident = F.when(F.col("h.cls") == c, fid).otherwise(ident)
        domain = F.when(F.col("h.cls") == c, dom).otherwise(domain)
    joined = hot.alias("h").join(seen.alias("e"), _same_keys("h", "e") & (F.col("h.cls") == F.col("e.cls")), "left")
    return FD.emit(
        joined,
        finding_id=ident,
        domain=domain,
        severity="warn",
        title="request errors",
        metric="error_rate",
        value_num=F.col("count") / F.col("n_ops"),
        unit="ratio",
        threshold=f"ops >= {cfg.sc_min_ops}, rate > {cfg.sc_err_rate_floor}, count >= {cfg.sc_min_errors}",
        judged=F.col("n_ops"),
        excluded=F.col("group_total") - F.col("n_ops"),
        sample_kind="operation",
        s3_op=F.col("h.s3_op"),
        bucket=F.col("h.bucket"),
        ts_start=F.col("ts_start"),
        ts_end=F.col("ts_end"),
        evidence=F.col("e.evidence"),
    )


def tail_findings(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Groups whose p99 is many times the median, with the requests at or beyond p99."""
    heavy = scorecard(ops, cfg).where(
        (F.col("p99_over_p50") >= cfg.sc_tail_ratio) & (F.col("bucket").isNotNull() | F.col("s3_op").isNotNull())
    )
    slow = (
        _grouped(ops).where(C.timeable()).alias("o")
        .join(heavy.select(*KEYS, "ttfb_p99_ns").alias("h"), _same_keys("o", "h") & (F.col("o.ttfb_ns") >= F.col("h.ttfb_p99_ns")))
        .select("o.*")
    )
    seen = FD.evidence(slow, KEYS, cfg.max_evidence)
    return FD.emit(
        heavy.alias("h").join(seen.alias("e"), _same_keys("h", "e"), "left"),
        finding_id="scorecard-latency-tail",
        domain="s3",
        severity="advisory",
        title="latency tail",
        metric="p99_over_p50",
        value_num=F.col("p99_over_p50"),
        unit="ratio",
        threshold=f">= {cfg.sc_tail_ratio}x",
        judged=F.col("latency_sample"),
        excluded=F.col("group_total") - F.col("latency_sample"),
        sample_kind="operation",
        s3_op=F.col("h.s3_op"),
        bucket=F.col("h.bucket"),
        ts_start=F.col("ts_start"),
        ts_end=F.col("ts_end"),
        evidence=F.col("e.evidence"),
    )


def unjudged_run(ops: DataFrame, window: DataFrame) -> DataFrame:
    """One explicit row when no group can be scored, so silence never reads as green."""
    pop = ops.agg(F.count(F.lit(1)).alias("seen"), F.count("http_status").alias("answered"))
    w = window.select(F.struct("ts_start", "ts_end"))
    return FD.emit(
        pop.where(F.col("answered") == 0).withColumn("w", w.scalar()),
        finding_id="scorecard-run",
        domain="run",
        severity="unjudged",
        title="scorecard run",
        metric="scoreable_groups",
        value_num=0.0,
        unit="count",
        threshold="groups >= 1",
        judged=0,
        excluded=F.col("seen"),
        sample_kind="operation",
        ts_start=F.col("w.ts_start"),
        ts_end=F.col("w.ts_end"),
    )


def capture_window(*records: DataFrame) -> DataFrame:
    """One row: min and max ts over every record kind, 0/0 when there is none."""
    spans = FD.union_all([r.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")) for r in records])
    return spans.agg(
        F.coalesce(F.min("lo"), F.lit(0)).alias("ts_start"), F.coalesce(F.max("hi"), F.lit(0)).alias("ts_end")
    )


def scorecard_findings(ops: DataFrame, window: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return FD.union_all([reliability_findings(ops, cfg), tail_findings(ops, cfg), unjudged_run(ops, window)])
