"""Sharding by a hierarchical weighted hash tree, on DataFrame functions alone.

A topology is a tree of regions, racks and shards with weights. A row descends from the root: at each
level every child draws a number from the hash of (row key, child's path), scaled by the child's weight,
and the smallest draw wins (-ln(u) / weight, so a child wins in proportion to its weight). A draw depends
on that child alone. So when weights change below one node, only rows of the subtrees whose weights
changed can move, and a new region takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard number -> weight
Topology = dict[str, dict[str, dict[int, float]]]

#: Slices that a shard's rows are numbered in: a shard is never sorted in one task.
SLICES = 4096


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Topology:
    """Equal shards in racks in regions."""
    tree: Topology = {}
    for s in range(shards):
        rack = s // shards_per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown(tree: Topology, weight: float = 1.0) -> Topology:
    """The same tree with one more shard, in a region of its own, so that no row moves between old shards."""
    n = sum(len(shards) for racks in tree.values() for shards in racks.values())
    return {**tree, f"region{len(tree)}": {f"rack{n}": {n: weight}}}


def _uniform(key: Column, path: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _draw(key: Column, path: str, weight: float) -> Column:
    return -F.log(_uniform(key, path)) / weight


def _winner(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the smallest draw; options of weight 0 never win."""
    live = [F.struct(_draw(key, path, w).alias("d"), F.lit(path).alias("p"), value.alias("v")) for path, w, value in options if w > 0]
    return (F.least(*live) if len(live) > 1 else live[0])["v"]


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def place(key: Column, tree: Topology) -> Column:
    """The shard of a row key. Null is a key like any other; equal keys share a shard."""
    if _weight(tree) <= 0:
        raise ValueError("a topology needs a shard of positive weight")
    text = F.concat(F.lit("k"), F.coalesce(key.cast("string"), F.lit("\u0000")))

    def descend(node: dict, path: str) -> Column:
        options = [
            (f"{path}/{name}", _weight(child), F.lit(name).cast("int") if not isinstance(child, dict) else descend(child, f"{path}/{name}"))
            for name, child in node.items()
            if _weight(child) > 0
        ]
        return _winner(text, options)

    return descend(tree, "")


def number_rows(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order of a hash of ``order`` and then ``order``.

    Rows are numbered per (group, hash slice), and a table of slice totals carries the numbers on.
    Rows that agree in everything take their numbers in any order.
    """
    cell = df.withColumn("__llm_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int"))
    running = Window.partitionBy("__llm_g").orderBy("__llm_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cell.groupBy(F.col(group).alias("__llm_g"), F.col("__llm_slice").alias("__llm_s"))
        .agg(F.count(F.lit(1)).alias("__llm_n"))
        .select("__llm_g", "__llm_s", F.coalesce(F.sum("__llm_n").over(running), F.lit(0)).alias("__llm_before"))
    )
    local = F.row_number().over(Window.partitionBy(group, "__llm_slice").orderBy(*order))
    numbered = cell.withColumn("__llm_local", local)
    joined = numbered.join(carry, (F.col(group) == F.col("__llm_g")) & (F.col("__llm_slice") == F.col("__llm_s")))
    return joined.withColumn(out, F.col("__llm_before") + F.col("__llm_local") - 1).drop("__llm_g", "__llm_s", "__llm_n", "__llm_before", "__llm_local", "__llm_slice")


def shard_documents(df: DataFrame, tree: Topology, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with size, text_crc32, shard, slot and grown_shard.

    * Size is the text's UTF-8 bytes plus 1; null has no bytes, and its check sum is that of no bytes, 0.
    * Rows with equal keys, null included, go to the same shard, whatever their text.
    * Slots of a shard run from 0 without gaps; equal rows get different slots.
    * ``grown_shard`` is the shard after one more region with one shard: the old shard or the new one.
    * Columns of ``df`` with one of these names are replaced. No rows give no rows.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    placed = (
        df.withColumn("size", F.octet_length(raw).cast("long") + 1)
        .withColumn("text_crc32", F.crc32(raw))
        .withColumn("shard", place(F.col(key), tree))
        .withColumn("grown_shard", place(F.col(key), grown(tree)))
    )
    return number_rows(placed, "shard", [F.col(key), F.col("text_crc32"), F.col("size")], "slot")
