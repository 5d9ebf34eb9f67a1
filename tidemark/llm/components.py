"""Connected components of a graph that is too large for one task, by alternating star contractions.

Each round links every node's larger neighbours to the smallest node around it, then every node's smaller
neighbours to that smallest node, until nothing changes: stars are left, whose centres name the components.
Rounds are written to the shared folder, so no round is computed twice and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = both.join(least, F.col("u") == F.col("c"))
    if larger:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select("u", F.col("m").alias("v")).unionByName(linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written once, with their number and a sum over them, which the same write counts."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
    kept = materialize(counted, "edges")
    return kept, (seen.get["n"], seen.get["mark"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); the component is its smallest node."""
    now, mark = _stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None if mark[0] else mark
    while mark != before:
        before = mark
        now, mark = _stored(_star(_star(now, True), False).filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
