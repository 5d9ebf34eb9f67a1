import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.operators.slices import CELL, HOME, SKETCH_GROUPS, lagged, prefix, range_halo, sketches, with_slices


def rows(seed, n=400, keys=3):
    r = random.Random(seed)
    return [(r.choice("abc"[:keys]) if i % 3 else "a", r.randrange(0, 5000), i, r.randrange(0, 9)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_matches_plain_window(spark, seed):
    df = spark.createDataFrame(rows(seed), "k string, t long, i long, v long")
    for frame in ("rows_upto", "rows_before", "range_upto", "range_before"):
        got = prefix(
            df, ["k"], "t",
            {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, ties=("i",), frame=frame,
        )
        w = Window.partitionBy("k").orderBy("t", *(["i"] if frame.startswith("rows") else []))
        end = 0 if frame.endswith("upto") else -1
        w = (w.rowsBetween if frame.startswith("rows") else w.rangeBetween)(Window.unboundedPreceding, end)
        want = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))).withColumn("m", F.max("v").over(w))
        cols = ["k", "t", "i", "v", "s", "m"]
        assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(
            map(tuple, want.select(cols).collect()), key=str
        ), frame


def test_prefix_last_known(spark):
    df = spark.createDataFrame(rows(5), "k string, t long, i long, v long").withColumn(
        "v", F.when(F.col("v") > 5, F.col("v"))
    )
    got = prefix(df, ["k"], "t", {"p": ("last", F.col("v"))}, ties=("i",), frame="rows_before")
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("p", F.last("v", ignorenulls=True).over(w))
    assert sorted(got.select("i", "p").collect()) == sorted(want.select("i", "p").collect())


def test_lag_and_lead_across_slices(spark):
    df = spark.createDataFrame(rows(7), "k string, t long, i long, v long")
    got = lagged(df, ["k"], "t", {"a": ("v", 1), "b": ("v", 5), "c": ("v", -2)}, ties=("i",))
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("i", F.lag("v", 1).over(w).alias("a"), F.lag("v", 5).over(w).alias("b"), F.lead("v", 2).over(w).alias("c"))
    assert sorted(map(tuple, got.select("i", "a", "b", "c").collect())) == sorted(map(tuple, want.collect()))


def test_range_halo_is_exact(spark):
    df = spark.createDataFrame(rows(9), "k string, t long, i long, v long")
    h = range_halo(df, "t", back=70, ahead=30, factor=2)
    w = Window.partitionBy("k", CELL).orderBy("t").rangeBetween(-70, 30)
    got = h.withColumn("s", F.sum("v").over(w)).where(HOME).select("i", "s")
    want = df.select("i", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-70, 30)).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("zoom", [False, True])
def test_quantiles_match_definition(spark, zoom):
    r = random.Random(3)
    data = []
    for g in range(1, 40):
        for _ in range(g):
            data.append((f"g{g}" if g % 5 else None, r.choice([r.random() * 10, -3.5, 2.0, float(r.randrange(10**9))]), r.randrange(7)))
    df = spark.createDataFrame(data, "g string, x double, y long")
    got = exact_quantiles(
        df, ["g"], {"x": F.col("x"), "y": F.when(F.col("y") > 2, F.col("y"))},
        [Stat("m", "x", "mid"), Stat("u", "x", "upper"), Stat("p", "x", 0.95), Stat("ym", "y", "mid")], zoom=zoom,
    )
    want = {}
    for g in {d[0] for d in data}:
        xs = sorted(d[1] for d in data if d[0] == g)
        ys = sorted(d[2] for d in data if d[0] == g and d[2] > 2)
        mid = lambda a: None if not a else (a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2
        want[g] = (mid(xs), xs[len(xs) // 2], xs[max(1, math.ceil(0.95 * len(xs))) - 1], mid(ys), len(xs), len(ys))
    assert {x["g"]: (x.m, x.u, x.p, x.ym, x.n_x, x.n_y) for x in got.collect()} == want
    one = exact_quantiles(df, [], {"x": F.col("x")}, [Stat("m", "x", "mid")], zoom=zoom).collect()
    xs = sorted(d[1] for d in data)
    assert one[0].m == (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2
    assert exact_quantiles(df.where("false"), [], {"x": F.col("x")}, [Stat("m", "x", "mid")]).count() == 0


def largest_slice(df, order):
    from tidemark.operators.slices import SLICE, with_slices

    got = with_slices(df, order, 32).groupBy(SLICE).count().toPandas()
    assert len(got) <= 32
    return got["count"].max() / (got["count"].sum() / 32)


def test_slices_hold_equal_rows_in_a_burst_and_with_stray_clocks(spark):
    ids = spark.range(20000)
    burst = ids.select(F.when(F.col("id") % 2 == 0, 5_000_000 + F.col("id") % 997).otherwise(F.col("id") * 1000).alias("t"))
    assert largest_slice(burst, "t") < 2
    stray = ids.select(F.when(F.col("id") % 100 == 0, F.col("id") * 10**14).otherwise(F.col("id")).alias("t"))
    assert largest_slice(stray, "t") < 2
    assert largest_slice(ids.select(F.lit(None).cast("bigint").alias("t")), "t") == 32


def rows_in_a_cell(df, values):
    from tidemark.operators import quantiles as Q

    c = Q._cell(F.col("v"))
    lo_hi = df.groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return lo_hi.orderBy(F.desc("n")).first().n


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_quantiles_of_continuous_values(spark, scale):
    """All values in one octave, or far below 1: cells stay small and the result exact."""
    r = random.Random(4)
    values = sorted((1 + r.random()) * scale for _ in range(5001))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows_in_a_cell(df, values) < 60
    got = exact_quantiles(df, [], {"x": F.col("v")}, [Stat("m", "x", "mid"), Stat("p", "x", 0.9)]).first()
    assert got.m == values[2500] and got.p == values[math.ceil(0.9 * 5001) - 1]
    mixed = spark.createDataFrame([(v,) for v in (-2.5, -1e-9, 0.0, 0.0, 1e-9, 3.0, 7.0)], "v double")
    assert exact_quantiles(mixed, [], {"x": F.col("v")}, [Stat("m", "x", "mid")]).first().m == 0.0


def test_slices_are_even_ordered_and_keep_ties_together(spark):
    """A burst, a stray clock, ties, nulls; whole numbers beyond a double's reach and fractions."""
    big = 1_700_000_000_000_000_000
    t = F.when(F.col("id") % 10 < 7, big + F.col("id") % 5000).when(F.col("id") % 10 == 7, big + 10**13 * F.col("id")).when(F.col("id") % 10 == 8, F.lit(big - 5)).otherwise(None)
    for order in (t.cast("bigint"), (F.col("id") % 3001) / 7.0):
        df = with_slices(spark.range(100_000, numPartitions=7).select(order.alias("t")), "t", 64)
        found = df.where("t IS NOT NULL").groupBy("_slice").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_slice").collect()
        assert all(a.hi < b.lo for a, b in zip(found, found[1:], strict=False))
        largest_tie = df.where("t IS NOT NULL").groupBy("t").count().agg(F.max("count")).first()[0]
        assert len(found) > 40 and max(r.n for r in found) <= 2 * 100_000 / 64 + largest_tie
    assert with_slices(spark.createDataFrame([(None,)] * 3, "t bigint"), "t").select("_slice").distinct().collect()[0][0] == 0
    assert with_slices(spark.range(0).withColumnRenamed("id", "t"), "t").count() == 0


def test_the_last_task_of_the_cuts_reads_no_summary_of_each_map_task(spark):
    """A thousand map tasks: what the last merge reads is bounded by the groups, and a sketch by its size, not its rows."""
    few, many = (sketches(spark.range(rows, numPartitions=1000), "id", 16).agg(F.count("*").alias("n"), F.sum(F.length("sketch")).alias("b")).first() for rows in (100_000, 4_000_000))
    assert few.n == many.n == SKETCH_GROUPS
    assert many.b < 8_000_000 and many.b < SKETCH_GROUPS * 3.5 * 8 * 512
