"""Exact order statistics that scale with neither the group nor the value domain.

``percentile`` keeps every distinct value of a group in one task. Here a first
pass counts values per logarithmic cell (partial aggregation, a few thousand
cells per group at most), the cells holding the wanted ranks are picked from the
counts, and a second pass looks only at the values inside those cells. With
``zoom`` the picked cells are cut once more, for continuous values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_OCTAVE = 256
_ZOOM = 4096
_OCTAVES_BELOW_1 = 1100  # more than a double has


@dataclass(frozen=True)
class Stat:
    """One order statistic.

    kind: ``mid`` (mean of the middle two), ``upper`` (sorted[n div 2]) or a number
    p in (0, 1] for the nearest rank ceil(p * n).
    """

    name: str
    value: str
    kind: str | float


def _ranks(kind: str | float, n: Column) -> list[Column]:
    if kind == "mid":
        return [F.floor((n - 1) / 2).cast("bigint"), F.floor(n / 2).cast("bigint")]
    if kind == "upper":
        return [F.floor(n / 2).cast("bigint")]
    r = F.ceil(F.lit(float(kind)) * n.cast("double")).cast("bigint")
    return [F.greatest(F.lit(1), F.least(r, n)) - 1]


def _cell(v: Column) -> Column:
    """A 256th of an octave, of values far below 1 as well; 0 is a cell of its own."""
    octaves = F.log2(F.abs(v)) + _OCTAVES_BELOW_1
    return F.when(v == 0, 0).otherwise((F.signum(v) * F.floor(octaves * _PER_OCTAVE)).cast("int"))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    stats: list[Stat],
    *,
    zoom: bool | None = None,
) -> DataFrame:
    """One row per key with every stat and ``n_<value>``, the count of non-null values.

    ``zoom`` cuts the picked cells once more; by default where a value is a fraction, as then nearly all
    rows of a cell differ.

    Groups in which every value is null do not appear. With no keys the result is one
    row, or none if there is no value at all. Keys may be null.
    """
    names = list(values)
    if zoom is None:
        kinds = df.select(*[values[v].alias(v) for v in names]).dtypes
        zoom = any(kind in ("double", "float") or kind.startswith("decimal") for _, kind in kinds)
    long = (
        df.select(
            *keys,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("m"), values[v].cast("double").alias("v"))
                        for i, v in enumerate(names)
                    ]
                )
            ).alias("_x"),
        )
        .select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
        .where(F.col("_v").isNotNull())
        .withColumn("_c", _cell(F.col("_v")))
    )
    g = [*keys, "_m"]

    def locate(counts: DataFrame, within: list[str], cell: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(cell)
        return counts.withColumn(
            "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )

    hist = long.groupBy(*g, "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    hist = locate(hist, g, "_c").withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*g).orderBy("_c").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    )
    total = F.col("_total")
    per_metric = [
        F.when(
            F.col("_m") == i,
            F.array(
                *[
                    F.struct(F.lit(s).alias("s"), F.lit(j).alias("j"), r.alias("r"))
                    for s, st in enumerate(stats)
                    if st.value == v
                    for j, r in enumerate(_ranks(st.kind, total))
                ]
            ),
        )
        for i, v in enumerate(names)
        if any(st.value == v for st in stats)
    ]
    in_cell = (F.col("_before") <= F.col("_t.r")) & (F.col("_t.r") < F.col("_before") + F.col("_n"))
    wanted = (
        hist.withColumn("_t", F.explode(F.coalesce(*per_metric)))
        .where(in_cell)
        .select(
            *g, "_c", "_lo", "_hi", "_total",
            F.col("_t.s").alias("_s"), F.col("_t.j").alias("_j"),
            (F.col("_t.r") - F.col("_before")).alias("_r"),
        )
    )

    cells, path = wanted, ["_c"]
    inside = long
    if zoom:
        frac = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        sub = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(_ZOOM - 1), F.floor(frac * _ZOOM).cast("int"))).otherwise(0)
        span = wanted.groupBy(*g, "_c").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        inside = (
            long.alias("a").join(span.alias("b"), _pairs("a", "b", [*g, "_c"]))
            .select("a.*", "b._lo", "b._hi")
            .withColumn("_z", sub)
            .drop("_lo", "_hi")
        )
        fine = locate(inside.groupBy(*g, "_c", "_z").agg(F.count(F.lit(1)).alias("_n")), [*g, "_c"], "_z")
        cells = (
            wanted.alias("a").join(fine.alias("b"), _pairs("a", "b", [*g, "_c"]))
            .where((F.col("b._before") <= F.col("a._r")) & (F.col("a._r") < F.col("b._before") + F.col("b._n")))
            .select(*[f"a.{c}" for c in [*g, "_c"]], "b._z", "a._total", "a._s", "a._j",
                    (F.col("a._r") - F.col("b._before")).alias("_r"))
        )
        path = ["_c", "_z"]

    at = [*g, *path]
    hit = cells.select(*at).distinct()
    exact = (
        inside.alias("a").join(hit.alias("b"), _pairs("a", "b", at), "left_semi")
        .groupBy(*at, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    exact = locate(exact, at, "_v")
    picked = (
        cells.alias("a").join(exact.alias("b"), _pairs("a", "b", at))
        .where((F.col("b._before") <= F.col("a._r")) & (F.col("a._r") < F.col("b._before") + F.col("b._n")))
        .select(*[f"a.{c}" for c in g], "a._total", "a._s", "a._j", "b._v")
    )
    out = picked.groupBy(*keys).agg(
        *[
            (
                (F.max(F.when((F.col("_s") == s) & (F.col("_j") == 0), F.col("_v")))
                 + F.max(F.when((F.col("_s") == s) & (F.col("_j") == 1), F.col("_v")))) / 2.0
                if st.kind == "mid"
                else F.max(F.when(F.col("_s") == s, F.col("_v")))
            ).alias(st.name)
            for s, st in enumerate(stats)
        ],
        *[
            F.coalesce(F.max(F.when(F.col("_m") == i, F.col("_total"))), F.lit(0)).alias(f"n_{v}")
            for i, v in enumerate(names)
        ],
    )
    return out if keys else out.where(F.greatest(*[F.col(f"n_{v}") for v in names], F.lit(0)) > 0)


def _pairs(a: str, b: str, cols: list[str]) -> Column:
    cond = None
    for c in cols:
        # only caller-supplied keys can be null; the helper columns never are
        l, r = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        e = (l == r) if c.startswith("_") else l.eqNullSafe(r)
        cond = e if cond is None else cond & e
    return cond
