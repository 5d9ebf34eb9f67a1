"""Regional latency read from captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.session import materialize


def region_floors_ms(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per region the median round trip and jitter in ms; a region nothing measured is NULL."""
    known = conns.where(F.col("region").isNotNull())
    med = exact_quantiles(
        known, ["region"],
        {"f": C.usable_rtt(F.col("srtt_us"), cfg) / 1e3, "j": F.when(F.col("rttvar_us") > 0, F.col("rttvar_us") / 1e3)},
        [Stat("floor_ms", "f", "mid"), Stat("jitter_ms", "j", "mid")],
    )
    return known.groupBy("region").agg(F.count(F.lit(1)).alias("conns")).join(med.select("region", "floor_ms", "jitter_ms"), "region", "left")


def latency_map(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per region, nearest first: floor, jitter, distance to the nearest, band, city."""
    m = region_floors_ms(conns, cfg)
    w = Window.orderBy("floor_ms", "region")  # over one row per region, already aggregated
    ranked = m.where(F.col("floor_ms").isNotNull()).withColumn("rank", F.row_number().over(w)).withColumn(
        "vs_nearest_ms", F.col("floor_ms") - F.first("floor_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    blank = m.where(F.col("floor_ms").isNull()).withColumn("rank", F.lit(None).cast("int")).withColumn("vs_nearest_ms", F.lit(None).cast("double"))
    return ranked.unionByName(blank).select(
        "region", C.region_city(F.col("region")).alias("city"), "conns", "floor_ms", "jitter_ms", "rank", "vs_nearest_ms",
        C.distance_band(F.col("floor_ms")).alias("band"), C.path_stability(F.col("floor_ms"), F.col("jitter_ms")).alias("stability"),
    )


def placement(latency: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: nearest, runner-up, farthest, spread and how many regions cluster near."""
    m = materialize(latency.where(F.col("floor_ms").isNotNull()).select("region", "floor_ms", "rank"), "latency")
    m = m.withColumn("nearest_ms", m.agg(F.min("floor_ms")).scalar())
    near = F.min(F.struct("floor_ms", "region"))
    gap = F.greatest(F.lit(cfg.cluster_min_ms), cfg.cluster_frac * F.col("nearest_ms"))
    one = m.agg(
        near.alias("n"), F.max(F.struct("floor_ms", "region")).alias("f"), F.count(F.lit(1)).alias("regions"),
        F.min(F.when(F.col("rank") == 2, F.struct("floor_ms", "region"))).alias("r"),
        F.count_if(F.col("floor_ms") <= F.col("nearest_ms") + gap).cast("int").alias("clustered"),
    )
    return one.where(F.col("regions") > 0).select(
        "regions", F.col("n.region").alias("nearest"), F.col("n.floor_ms").alias("nearest_ms"), F.col("r.region").alias("runner_up"),
        (F.col("r.floor_ms") - F.col("n.floor_ms")).alias("runner_up_gap_ms"), F.col("f.region").alias("farthest"),
        (F.col("f.floor_ms") - F.col("n.floor_ms")).alias("spread_ms"), (F.col("f.floor_ms") / F.col("n.floor_ms")).alias("spread_ratio"),
        "clustered",
    )


def triage(buckets: DataFrame, latency: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Buckets whose round trip could be much shorter elsewhere.

    ``buckets``: bucket, bucket_ms. The regional floors are a small array carried as a scalar.
    """
    m = latency.where(F.col("floor_ms").isNotNull())
    floors = m.agg(F.array_sort(F.collect_list(F.struct("floor_ms", "region"))).alias("a"))
    b = buckets.withColumn("_f", floors.scalar()).where(F.size("_f") > 0)
    near = F.col("_f")[0]
    closest = F.array_min(
        F.transform("_f", lambda x: F.struct(F.abs(x["floor_ms"] - F.col("bucket_ms")).alias("d"), x["floor_ms"].alias("floor_ms"), x["region"].alias("region")))
    )
    like = F.when((closest["region"] != near["region"]) & (closest["d"] <= 0.25 * F.col("bucket_ms")), closest["region"])
    avoidable = F.col("bucket_ms") - near["floor_ms"]
    return b.where((avoidable >= cfg.triage_min_ms) & (F.col("bucket_ms") >= cfg.triage_min_ratio * near["floor_ms"])).select(
        "bucket", "bucket_ms", near["region"].alias("nearest"), near["floor_ms"].alias("nearest_ms"), avoidable.alias("avoidable_ms"), like.alias("similar_to")
    )
