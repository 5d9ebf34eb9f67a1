"""Writing judgments: JSON lines with nested records, or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import schemas as S


def finding_records(findings: DataFrame, namespace: str = "tidemark", emitted_at: str | None = None, recommendations: dict[str, str] | None = None) -> DataFrame:
    """The nested wire record: decimal-string window, sample, scope and evidence structs.

    ``emitted_at`` is the caller's, and null by default: findings are a function of their records, so writing them
    twice gives the same bytes. ``recommendations`` names, by finding id, where advice on a finding is written.
    """
    advice = F.lit(None).cast("string")
    for finding, ref in (recommendations or {}).items():
        advice = F.when(F.col("finding_id") == finding, F.lit(ref)).otherwise(advice)
    return findings.select(
        F.lit(f"{namespace}.{S.FINDING_TAG}").alias("schema"),
        F.lit(emitted_at).cast("string").alias("emitted_at"),
        F.array(*[F.lit(f"{namespace}.{tag}") for tag, kind in S.KIND_TAGS.items() if kind != "sample"]).alias("source_schema"),
        "finding_id", "domain", "title", "severity", "verdict",
        F.concat(F.coalesce("title", "finding_id"), F.lit(": "), F.coalesce("verdict", "severity")).alias("summary"),
        advice.alias("recommendation_ref"), "metric",
        "value_num", "value_str", "unit", "baseline_rtt_us", "ratio_to_rtt", "threshold",
        F.struct("judged", "excluded", F.col("sample_kind").alias("kind")).alias("sample"),
        F.struct("s3_op", "bucket", "prefix_hash", "region", "app_pid").alias("scope"),
        F.struct(F.col("ts_start").cast("string").alias("ts_start"), F.col("ts_end").cast("string").alias("ts_end")).alias("window"),
        "evidence",
    )


def scorecard_records(rows: DataFrame, namespace: str = "tidemark") -> DataFrame:
    return rows.select(
        F.lit(f"{namespace}.{S.SCORECARD_TAG}").alias("schema"),
        "bucket", "s3_op", "ops", "errors", "error_rate", "status_counts", "ttfb_p50_ns", "ttfb_p95_ns", "ttfb_p99_ns", "latency_sample",
        "throughput_bytes_per_s",
        F.struct(F.col("ts_start").cast("string").alias("ts_start"), F.col("ts_end").cast("string").alias("ts_end")).alias("window"),
    )


def refuse_broken_numbers(findings: DataFrame) -> DataFrame:
    """The row fails at write time if it carries a NaN or an infinity."""
    def checked(c: str) -> Column:
        v = F.col(c)
        bad = F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"not finite: {c} of "), "finding_id")).cast("double")).otherwise(v)

    return findings.withColumn("value_num", checked("value_num")).withColumn("ratio_to_rtt", checked("ratio_to_rtt"))


def write_findings(findings: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", **fields) -> None:
    """``fields``: what else ``finding_records`` takes."""
    finding_records(refuse_broken_numbers(findings), **fields).write.format(fmt).mode(mode).save(path)


def write_scorecard(rows: DataFrame, findings: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", **fields) -> None:
    """Two record kinds, rows and findings, side by side."""
    scorecard_records(rows).write.format(fmt).mode(mode).save(f"{path}/scorecard")
    write_findings(findings, f"{path}/findings", fmt, mode, **fields)
