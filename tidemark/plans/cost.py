"""What the observed requests cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def request_cost(ops: DataFrame) -> DataFrame:
    """(s3_op, count, tier, usd) per sanitised operation name."""
    return (
        ops.where(F.col("s3_op").isNotNull())
        .groupBy(C.sanitize_term(F.col("s3_op")).alias("s3_op"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("tier", C.price_tier(F.col("s3_op")))
        .withColumn("usd", F.col("count") / 1000.0 * C.price_per_1k(F.col("tier")))
    )


def capture_cost(ops: DataFrame) -> DataFrame:
    """One row: request dollars, GiB returned by measured 2xx reads, errors, unmeasured reads."""
    ok = F.col("http_status").between(200, 299)
    read = F.coalesce(F.col("s3_op").startswith("Get"), F.lit(False)) | F.coalesce(F.col("verb") == "GET", F.lit(False))
    body = ok & read & F.col("download_ns").isNotNull()
    totals = ops.agg(
        F.count(F.lit(1)).alias("operations"),
        F.count_if(F.col("s3_op").isNotNull() & (F.col("http_status") >= 400)).alias("error_requests"),
        F.coalesce(F.sum(F.when(body, F.col("content_length"))), F.lit(0)).alias("bytes"),
        F.count_if(ok & read & F.col("download_ns").isNull() & F.col("content_length").isNotNull()).alias("unmeasured_gets"),
    )
    usd = request_cost(ops).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    return totals.withColumn("request_usd", usd.scalar()).select(
        "operations", "error_requests", "unmeasured_gets", "request_usd", (F.col("bytes") / float(1 << 30)).alias("gib_returned")
    )
