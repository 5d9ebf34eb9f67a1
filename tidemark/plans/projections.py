"""Row-level request projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C

PHASES = [
    ("dns", "dns_latency_ns", True),
    ("tcp_connect", "tcp_connect_ns", True),
    ("tls_handshake", "tls_handshake_ns", True),
    ("request_ttfb", "ttfb_ns", False),
    ("download", "download_ns", False),
]


def phase_breakdown(ops: DataFrame) -> DataFrame:
    """(op_id, phase, ns, share, offset_ns): the sequential phases of each request.

    A reused connection paid no setup, so its setup phases are absent; NULL means not
    measured. Share and offset are over the measured phases, computed inside the row.
    """
    setup = ~F.col("connection_reused")
    ns = [F.when(setup, F.col(c)) if first else F.col(c) for _, c, first in PHASES]
    filled = [F.coalesce(c, F.lit(0)) for c in ns]
    total = sum(filled[1:], filled[0])
    rows = []
    for i, (name, _, first) in enumerate(PHASES):
        offset = sum(filled[1:i], filled[0]) if i else F.lit(0).cast("bigint")
        rows.append(
            F.struct(
                F.lit(i).alias("phase_no"),
                F.lit(name).alias("phase"),
                ns[i].alias("ns"),
                F.when(ns[i].isNotNull() & (total > 0), ns[i] / total).alias("share"),
                F.when(ns[i].isNotNull(), offset).alias("offset_ns"),
                (setup if first else F.lit(True)).alias("_keep"),
            )
        )
    return (
        ops.select("op_id", F.explode(F.array(*rows)).alias("p"))
        .where("p._keep")
        .select("op_id", "p.phase_no", "p.phase", "p.ns", "p.share", "p.offset_ns")
    )


def request_table(ops: DataFrame) -> DataFrame:
    """The columns of the request listing."""
    return ops.select(
        "op_id",
        C.sanitize_term(F.coalesce("s3_op", F.lit("?"))).alias("op"),
        C.sanitize_term(F.coalesce("bucket", F.lit("?"))).alias("bucket"),
        F.coalesce(F.col("http_status").cast("string"), F.lit("-")).alias("code"),
        (F.col("ttfb_ns") / 1e6).alias("ttfb_ms"),
        F.when(F.col("connection_reused"), "reuse").otherwise("new").alias("connection"),
        F.coalesce("op_bytes_recv", F.lit(0)).alias("bytes"),
        C.request_flags().alias("flags"),
    )


def ranged_share(trace: DataFrame) -> DataFrame:
    """One row: whole-object reads, ranged reads, unplaceable ranged reads and their share."""
    ranged = F.coalesce(F.col("status") == 206, F.lit(False))
    unplaceable = ranged & F.col("range_start").isNull()
    body = (F.col("op") == "get") | ranged
    return trace.agg(
        F.count_if((F.col("op") == "get") & ~ranged).alias("whole_gets"),
        F.count_if(ranged).alias("ranged"),
        F.count_if(unplaceable).alias("unplaceable"),
        F.count_if(body).alias("body_reads"),
    ).withColumn(
        "ranged_frac",
        F.when(F.col("body_reads") > 0, F.col("unplaceable") / F.col("body_reads")).otherwise(F.lit(0.0)),
    )


def in_scope(records: DataFrame, pids: list[int] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Keep the selected processes: a literal list, or a table with a ``pid`` column."""
    if pids is not None:
        return records.where(F.col("pid").isin(pids))
    return records.join(scope.select("pid").distinct(), "pid", "left_semi")
