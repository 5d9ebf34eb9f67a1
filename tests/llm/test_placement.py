"""The hash tree's descent against a walk in plain Python."""

import math

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import sharding


def weight(node):
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def walked(key, tree):
    text = ("k" + ("\0" if key is None else str(key))).encode()
    node, path = tree, ""
    while isinstance(node, dict):
        draws = []
        for name, child in node.items():
            if weight(child) > 0:
                at = f"{path}/{name}"
                h = xxhash.xxh64(at.encode(), seed=xxhash.xxh64(text, seed=42).intdigest()).intdigest()
                draws.append((-math.log(((h >> 11) + 0.5) / 2**53) / weight(child), at, name, child))
        _, path, shard, node = min(draws, key=lambda d: d[:2])
    return shard


def test_places_equal_a_plain_descent(spark):
    even = sharding.topology(8)
    uneven = {"a": {"r1": {0: 1.0, 1: 5.0}, "r2": {2: 0.0, 3: 2.5}}, "b": {"r3": {4: 0.25}}}
    keys = [None, 0, -1, 10**18, *range(1, 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    trees = {"even": even, "uneven": uneven, "grown": sharding.grown(even)}
    rows = df.select("k", *[sharding.place(F.col("k"), t).alias(n) for n, t in trees.items()]).collect()
    assert len(rows) == len(keys)
    for r in rows:
        assert all(r[n] == walked(r.k, t) for n, t in trees.items()), r.k
    assert {r.uneven for r in rows} == {0, 1, 3, 4}
