"""Round-trip floors: per connection, per region, pooled, and whether pooling is allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.session import materialize


def unambiguous(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per cookie carried by exactly one connection; reused cookies identify nothing."""
    return (
        conns.groupBy("sock_cookie")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.first(C.conn_floor_us(cfg)).alias("own_floor_us"),
            F.first("region").alias("conn_region"),
        )
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def region_floors(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return exact_quantiles(
        conns, ["region"], {"f": C.conn_floor_us(cfg)}, [Stat("region_floor_us", "f", "mid")]
    ).select("region", "region_floor_us")


def multi_path(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row ``mixed``: several regions, or a bimodal far srtt; one floor then fits no path."""
    region = F.lower(F.trim("region"))
    srtt = C.usable_rtt(F.col("srtt_us"), cfg)
    return conns.agg(
        F.min(F.when(region != "", region)).alias("r0"),
        F.max(F.when(region != "", region)).alias("r1"),
        F.min(srtt).alias("lo"),
        F.max(srtt).alias("hi"),
    ).select(
        F.coalesce(
            (F.col("r0") != F.col("r1"))
            | ((F.col("hi") / F.col("lo") >= cfg.mixed_srtt_ratio) & (F.col("hi") / 1000.0 >= cfg.far_path_ms)),
            F.lit(False),
        ).alias("mixed")
    )


def pooled_floor(conns: DataFrame, samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: the floor ladder close srtt -> sampled min_rtt -> sampled srtt -> none.

    floor_us, source, judged and excluded (records that could not take part).
    """
    both = conns.select(
        F.lit(1).alias("is_conn"), C.usable_rtt(F.col("srtt_us"), cfg).alias("c_srtt"),
        F.lit(None).cast("bigint").alias("s_min"), F.lit(None).cast("bigint").alias("s_srtt"),
    ).unionByName(
        samples.select(
            F.lit(0).alias("is_conn"), F.lit(None).cast("bigint").alias("c_srtt"),
            C.usable_rtt(F.col("min_rtt_us"), cfg).alias("s_min"), C.usable_rtt(F.col("srtt_us"), cfg).alias("s_srtt"),
        )
    )
    # the sampled rungs are looked at only when no connection closed with a usable srtt
    closed = conns.agg((F.count(C.usable_rtt(F.col("srtt_us"), cfg)) > 0).alias("x"))
    med = exact_quantiles(
        both.withColumn("_closed", closed.scalar()).where((F.col("is_conn") == 1) | ~F.col("_closed")),
        [],
        {c: F.col(c) for c in ("c_srtt", "s_min", "s_srtt")},
        [Stat(f"m_{c}", c, "mid") for c in ("c_srtt", "s_min", "s_srtt")],
    )
    pop = both.agg(
        F.coalesce(F.sum("is_conn"), F.lit(0)).alias("conns"),
        F.coalesce(F.sum(1 - F.col("is_conn")), F.lit(0)).alias("samples"),
    )
    return (
        pop.withColumn("q", med.select(F.struct("*")).scalar())
        .select("conns", "samples", "q.*")
        .select(
            F.coalesce("m_c_srtt", "m_s_min", "m_s_srtt").alias("floor_us"),
            F.when(F.col("m_c_srtt").isNotNull(), "srtt")
            .when(F.col("m_s_min").isNotNull(), "min_rtt (sampled)")
            .when(F.col("m_s_srtt").isNotNull(), "srtt (sampled)")
            .otherwise("none")
            .alias("source"),
            F.when(F.col("m_c_srtt").isNotNull(), F.col("n_c_srtt"))
            .when(F.col("m_s_min").isNotNull(), F.col("n_s_min"))
            .when(F.col("m_s_srtt").isNotNull(), F.col("n_s_srtt"))
            .otherwise(0)
            .cast("bigint")
            .alias("judged"),
            F.when(F.col("m_c_srtt").isNotNull(), F.col("conns") - F.col("n_c_srtt"))
            .when(F.col("m_s_min").isNotNull(), F.col("samples") - F.col("n_s_min"))
            .when(F.col("m_s_srtt").isNotNull(), F.col("conns") + F.col("samples") - F.col("n_s_srtt"))
            .otherwise(F.col("conns") + F.col("samples"))
            .cast("bigint")
            .alias("excluded"),
        )
    )


def with_floors(ops: DataFrame, conns: DataFrame, pooled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``floor_us`` to every request: own connection, else its region, else the pooled
    floor unless the capture spans several paths, else NULL.

    Requests are shuffled once, on the socket; the region floor is resolved on the
    connection side first. The pooled floor and the path flag arrive as scalar subqueries.
    """
    known = (
        unambiguous(conns, cfg).alias("u")
        .join(region_floors(conns, cfg).alias("r"), F.col("u.conn_region") == F.col("r.region"), "left")
        .select("u.sock_cookie", F.coalesce("u.own_floor_us", "r.region_floor_us").alias("conn_floor_us"))
    )
    return (
        ops.join(known, "sock_cookie", "left")
        .withColumn("_pooled", pooled.select("floor_us").scalar())
        .withColumn("_mixed", multi_path(conns, cfg).scalar())
        .withColumn("floor_us", F.coalesce("conn_floor_us", F.when(~F.col("_mixed"), F.col("_pooled"))))
        .drop("conn_floor_us", "_pooled", "_mixed")
    )


# what the judged rows of a report read from a request
REPORT_COLUMNS = [
    "s3_op", "http_status", "partial", "delimitation", "connection_reused", "ttfb_ns", "download_ns", "content_length",
    "dns_latency_ns", "dns_cache_hit", "tcp_connect_ns",
]


def judged_requests(ops: DataFrame, conns: DataFrame, pooled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The requests of a report with their floors, stored once.

    Counts, order statistics (two scans each) and class rows all read them; storing the
    narrow result costs one shuffle on the socket instead of one per reader.
    """
    return materialize(with_floors(ops.select("sock_cookie", *REPORT_COLUMNS), conns, pooled, cfg).drop("sock_cookie"), "judged-requests")
