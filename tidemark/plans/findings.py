"""The uniform judgment row, its evidence sample and the union of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE_TYPE = "struct<op_ids:array<string>,sock_cookies:array<string>,aws_request_ids:array<string>>"

# name -> type; every check emits exactly these columns
FIELDS = {
    "finding_id": "string",
    "domain": "string",
    "severity": "string",
    "verdict": "string",
    "title": "string",
    "metric": "string",
    "value_num": "double",
    "value_str": "string",
    "unit": "string",
    "baseline_rtt_us": "bigint",
    "ratio_to_rtt": "double",
    "threshold": "string",
    "judged": "bigint",
    "excluded": "bigint",
    "sample_kind": "string",
    "s3_op": "string",
    "bucket": "string",
    "prefix_hash": "string",
    "region": "string",
    "app_pid": "bigint",
    "ts_start": "bigint",
    "ts_end": "bigint",
    "evidence": EVIDENCE_TYPE,
}


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def record(**given) -> Column:
    """A struct of all fields; what is not given is NULL."""
    unknown = given.keys() - FIELDS.keys()
    if unknown:
        raise ValueError(f"not a finding field: {sorted(unknown)}")
    return F.struct(*[_lit(given.get(n)).cast(t).alias(n) for n, t in FIELDS.items()])


def emit(df: DataFrame, **given) -> DataFrame:
    """One finding per row of ``df``."""
    return df.select(record(**given).alias("f")).select("f.*")


def emit_each(df: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """Per row of ``df`` the records whose condition holds; ``(condition, record)`` pairs."""
    picks = F.array(*[F.when(cond, rec) for cond, rec in candidates])
    return df.select(F.explode(F.array_compact(picks)).alias("f")).select("f.*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def evidence(ops: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """Per key the first few request ids in (time, id) order.

    The row_number filters become per-task group limits before the shuffle, so a hot key
    sends a handful of rows per task and not its population.
    """
    w = Window.partitionBy(*keys).orderBy("ts_ns", "op_id")
    first = (
        ops.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= limit)
        .groupBy(*keys)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", "op_id"))), lambda x: x["op_id"]).alias("op_ids"),
            F.array_sort(F.collect_set("sock_cookie")).alias("sock_cookies"),
        )
    )
    served = (
        ops.where(F.col("aws_request_id").isNotNull())
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= limit)
        .groupBy(*keys)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_r", "aws_request_id"))), lambda x: x["aws_request_id"]
            ).alias("aws_request_ids")
        )
    )
    cond = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return first.alias("a").join(served.alias("b"), cond, "left").select(
        *[f"a.{k}" for k in keys],
        F.struct(
            "a.op_ids",
            "a.sock_cookies",
            F.coalesce("b.aws_request_ids", F.array().cast("array<string>")).alias("aws_request_ids"),
        ).alias("evidence"),
    )


def flatten(findings: DataFrame, *, with_evidence: bool = False) -> DataFrame:
    """Plain columns for comparison with SQL: evidence lists become comma-joined strings."""
    out = findings
    if with_evidence:
        for part in ("op_ids", "sock_cookies", "aws_request_ids"):
            out = out.withColumn(part, F.array_join(F.col("evidence")[part], ","))
    return out.drop("evidence", "title", "threshold")


def broken_numbers(findings: DataFrame) -> DataFrame:
    """Findings that carry a NaN or infinite number; a sink must refuse them."""
    bad = F.lit(False)
    for c in ("value_num", "ratio_to_rtt"):
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return findings.where(F.coalesce(bad, F.lit(False)))
