"""Ordered operators that never put one whole key into one task.

A window partitioned by a socket, bucket, process or object is as large as the
hottest of them. Here every key is cut along its order column into slices, so a
window runs per (key, slice), and what a slice needs from its neighbours arrives
as a small carried summary:

* ``prefix``      running sum / max / last-known value over everything before a row
* ``row_halo``    the k neighbouring rows of a slice, for lag/lead and short row frames
* ``range_halo``  the rows within a fixed reach of a cell, for bounded range frames

Keys must be non-null (see ``functions.columns.fill_key``): plain equality lets
the carry join reuse the partitioning of the local window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

SLICE = "_slice"
HALO = "_halo"

#: Rows of a key that one task takes whole; only keys with more are cut, where ``with_slices`` is told the keys.
WHOLE_ROWS = 100_000
_UNCUT = "uncut"


def slice_count(df: DataFrame) -> int:
    """Slices per key: a few per shuffle partition, so the cut follows the cluster size."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Groups of map tasks whose sketches are merged before the last merge.
SKETCH_GROUPS = 256


def _sketch_size(n: int) -> int:
    """So large that a quantile is off by less than a slice: 2.3 / k^0.9 of the rows at most, for n up to some thousand."""
    return min(65_535, max(256, 32 * n))


def sketches(df: DataFrame, order: str, n: int) -> DataFrame:
    """(sketch): the distribution of ``order``, a sketch for each group of map tasks; its size does not grow with the rows."""
    kind = order_kind(df, order)
    part = df.select(F.spark_partition_id().alias("task"), F.col(order).cast(kind).alias("o")).where("o IS NOT NULL")
    return part.groupBy((F.col("task") % SKETCH_GROUPS).alias("g")).agg(F.call_function(f"kll_sketch_agg_{kind}", "o", F.lit(_sketch_size(n))).alias("sketch")).select("sketch")


def order_kind(df: DataFrame, order: str) -> str:
    return "bigint" if isinstance(df.schema[order].dataType, T.IntegralType) else "double"


def cut_points(df: DataFrame, order: str, n: int) -> Column:
    """The n - 1 values that cut ``order`` into n parts of about equally many rows, as a constant array.

    Sketches are merged in a tree (per task, per group of tasks, then one), so no task reads one for every map task. They
    are random, so the cuts are drawn once here: all that uses the array cuts alike. They are n numbers, whatever the rows.
    """
    kind = order_kind(df, order)
    shares = F.array(*[F.lit(k / n) for k in range(1, n)] or [F.lit(0.5)])
    whole = sketches(df, order, n).agg(F.call_function(f"kll_merge_agg_{kind}", "sketch").alias("s"), F.count(F.lit(1)).alias("some"))
    # without rows there is no sketch to ask
    cuts = whole.where("some > 0").select(F.call_function(f"kll_sketch_get_quantile_{kind}", "s", shares).alias("q")).first()
    if cuts is None:
        return F.lit(None).cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, sorted(set(cuts.q))))), ",").cast(f"array<{kind}>")


def uncut(df: DataFrame) -> bool:
    """Whether ``with_slices`` found no key to cut: then windows run over whole keys and nothing is carried."""
    return SLICE in df.columns and _UNCUT in df.schema[SLICE].metadata


def cell_of(df: DataFrame, keys: list[str]) -> list[str]:
    """What a window over ``keys`` is partitioned by."""
    return list(keys) if uncut(df) else [*keys, SLICE]


def with_slices(df: DataFrame, order: str, n: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Add ``_slice``, a monotone function of ``order`` (a number), with about equally many rows in each slice.

    With ``keys``, only keys of more than ``WHOLE_ROWS`` rows are cut; the slice of all others is -1. Where keys are many and short,
    a cut for each would make nearly every row a cell, and what is carried between cells as large as the table. Later steps may use the
    slices for these keys and for finer ones.

    The cuts are quantiles of the column, so a burst is cut as finely as it is dense, and stray clock values
    share the slices of what is near them. Equal values share a slice. A row finds its slice by bisection. The cuts are
    looked up at once, from ``order`` alone, so what it comes from should be stored or cheap.
    """
    n = n or slice_count(df)
    if keys:
        long = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE_ROWS).select(*[F.col(k).alias(f"_h_{k}") for k in keys]), "long-keys")
        if long.isEmpty():
            return df.select("*", F.lit(-1).alias(SLICE, metadata={_UNCUT: True}))
        same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        cut = with_slices(df.join(long.withColumn("_long", F.lit(True)), same, "left"), order, n)
        return cut.withColumn(SLICE, F.when(F.col("_long"), F.col(SLICE)).otherwise(-1)).drop("_long", *long.columns)
    cuts, o = cut_points(df, order, n), F.col(order).cast(order_kind(df, order))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < o, at + step).otherwise(at))
    return df.withColumn(SLICE, F.when(o.isNull() | cuts.isNull(), 0).otherwise(below).cast("int"))


def _ensure_slices(df: DataFrame, order: str, n: int | None) -> DataFrame:
    return df if SLICE in df.columns else with_slices(df, order, n)


_LOCAL = {
    "sum": lambda c: F.sum(c),
    "max": lambda c: F.max(c),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def prefix(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    *,
    ties: tuple[str, ...] = (),
    frame: str = "rows_upto",
    n: int | None = None,
) -> DataFrame:
    """Add running aggregates over all earlier rows of the same key.

    ``values`` maps an output name to ``("sum" | "max" | "last", expression)``.
    ``frame`` is one of rows_upto, rows_before (row positions; needs ``ties`` for a
    total order) or range_upto, range_before (by the value of ``order`` alone).
    """
    df = _ensure_slices(df, order, n)
    cell = cell_of(df, keys)
    by_rows = frame.startswith("rows")
    end = 0 if frame.endswith("upto") else -1
    w = Window.partitionBy(*cell).orderBy(order, *(ties if by_rows else ()))
    w = w.rowsBetween(Window.unboundedPreceding, end) if by_rows else w.rangeBetween(Window.unboundedPreceding, end)

    def total(kind: str, c: Column) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), F.struct(order, *ties)))
        return _LOCAL[kind](c)

    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = df
    for name, (kind, c) in values.items():
        local = local.withColumn(f"_l_{name}", _LOCAL[kind](c).over(w))
    if uncut(df):
        for name, (kind, _) in values.items():
            here = F.col(f"_l_{name}")
            local = local.withColumn(name, F.coalesce(here, F.lit(0)) if kind == "sum" else here)
        return local.drop(*[f"_l_{name}" for name in values])
    carry = (
        df.where(F.col(SLICE) >= 0)
        .groupBy(*cell)
        .agg(*[total(kind, c).alias(f"_t_{name}") for name, (kind, c) in values.items()])
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in cell],
            *[
                _LOCAL[kind](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}")
                for name, (kind, _) in values.items()
            ],
        )
    )
    out = local.join(carry, [F.col(k) == F.col(f"_k_{k}") for k in cell], "left")
    for name, (kind, _) in values.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out = out.withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)))
        elif kind == "max":
            out = out.withColumn(name, F.greatest(here, there))
        else:
            out = out.withColumn(name, F.coalesce(here, there))
    helpers = [f"_{p}_{name}" for name in values for p in "lc"] + [f"_k_{k}" for k in cell]
    return out.drop(*helpers)


def row_halo(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    ties: tuple[str, ...] = (),
    before: int = 0,
    after: int = 0,
    n: int | None = None,
) -> DataFrame:
    """``df`` with slices, plus up to ``before``/``after`` neighbouring rows of each cell.

    Halo rows carry ``_halo = true``. A row frame of at most that depth over
    (keys, slice) is then exact for the home rows; drop the halo rows afterwards.
    """
    df = _ensure_slices(df, order, n)
    if uncut(df):
        return df.withColumn(HALO, F.lit(False))
    cell = [*keys, SLICE]
    rest = [c for c in df.columns if c not in (*cell, order, *ties)]
    row = F.struct(order, *ties, *rest)
    parts = [df.withColumn(HALO, F.lit(False))]
    for depth, ascending in ((before, False), (after, True)):
        if not depth:
            continue
        cols = [F.col(c).asc() if ascending else F.col(c).desc() for c in (order, *ties)]
        edge = (
            df.where(F.col(SLICE) >= 0)
            .withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(*cols)))
            .where(F.col("_r") <= depth)
            .groupBy(*cell)
            .agg(F.array_sort(F.collect_list(row)).alias("_edge"))
        )
        side = Window.partitionBy(*keys).orderBy(SLICE)
        side = side.rowsBetween(1, depth) if ascending else side.rowsBetween(-depth, -1)
        carried = F.col("_carried")
        bounded = F.slice(carried, 1, depth) if ascending else F.reverse(F.slice(F.reverse(carried), 1, depth))
        parts.append(
            edge.select(*cell, F.flatten(F.collect_list("_edge").over(side)).alias("_carried"))
            .select(*cell, F.explode(bounded).alias("_x"))
            .select(*cell, "_x.*")
            .withColumn(HALO, F.lit(True))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lagged(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, tuple[str, int]],
    *,
    ties: tuple[str, ...] = (),
    n: int | None = None,
) -> DataFrame:
    """Lag (positive offset) or lead (negative offset) of columns within each key."""
    before = max([0, *(o for _, o in outputs.values())])
    after = max([0, *(-o for _, o in outputs.values())])
    h = row_halo(df, keys, order, ties=ties, before=before, after=after, n=n)
    w = Window.partitionBy(*cell_of(h, keys)).orderBy(order, *ties)
    for name, (c, off) in outputs.items():
        h = h.withColumn(name, F.lag(c, off).over(w) if off > 0 else F.lead(c, -off).over(w))
    return h.where(~F.col(HALO)).drop(HALO)


CELL = "_cell"
HOME = "_home"


def range_halo(df: DataFrame, order: str, *, back: int = 0, ahead: int = 0, factor: int = 16) -> DataFrame:
    """Cut ``order`` into cells ``factor`` times the reach and copy rows near an edge.

    A row is also placed in the next cell when a frame reaching ``back`` from there can
    see it, and in the previous cell for frames reaching ``ahead``. ``_home`` marks the
    one copy in the row's own cell; range frames of that reach per (keys, cell) are exact.
    """
    width = max(back, ahead, 1) * factor
    o = F.col(order)
    c = F.expr(f"({order} - pmod({order}, {width}L)) div {width}L")
    spots = [c]
    if back:
        spots.append(F.when(F.pmod(o, F.lit(width)) + back >= width, c + 1))
    if ahead:
        spots.append(F.when(F.pmod(o, F.lit(width)) < ahead, c - 1))
    return (
        df.withColumn("_own", c)
        .withColumn(CELL, F.explode(F.array_compact(F.array(*spots))))
        .withColumn(HOME, F.col(CELL) == F.col("_own"))
        .drop("_own")
    )
