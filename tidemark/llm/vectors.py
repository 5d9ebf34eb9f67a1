"""What the vector searches share: usable vectors, blocks of data against blocks of queries, merging.

A search pairs every block of queries with every block of data. Block sizes are constants, so a task's
memory does not grow with the input; the number of pairs of blocks does, as the stated query set asks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATA_BLOCK = 8192
QUERY_BLOCK = 4096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite components, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def in_blocks(data: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``search(data block, query block)`` for every pair of blocks of vectors of one length."""
    n, m = data.count(), queries.count()
    across, down = max(1, -(-n // DATA_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def block(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
        return df.withColumn("dim", F.size("v")).withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = block(data, "d", across, "q", down).groupBy("dim", "d", "q")
    right = block(queries, "q", down, "d", across).groupBy("dim", "d", "q")

    def pair(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return search(rows, asked)

    return left.cogroup(right).applyInArrow(pair, schema)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """Each query's ``k`` highest scores of all blocks, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
