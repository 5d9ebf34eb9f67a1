"""Vector searches against brute force, and on unusable vectors, ties, repeats and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, mtree
from tidemark.llm.vectors import top

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, id string, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [math.nan] * 16), (2060, [math.inf] + [0.0] * 15), (2080, [None] + [1.0] * 15), (None, rows[1][1])]
    rows += [(2100, []), (2120, [1.0, 2.0]), (2121, [3.0, 1.0]), rows[7]]
    return spark.createDataFrame([(i, v, 0, "s", "r", "i", "v") for i, v in rows], SCHEMA).repartition(4)


def usable_rows(df, zeros):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (zeros or v.any())]


def brute(rows, every, k, value):
    out = {}
    for i, v in rows:
        if i % every == 0:
            found = sorted((-value(v, w), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_search_equals_brute_force(vectors):
    rows = usable_rows(vectors, zeros=True)
    got = answers(mtree.exact_top(vectors, F.col("id") % 20 == 0, k=10))
    whole = lambda v: np.floor(1024 * v).astype(np.int64)
    want = brute(rows, 20, 10, lambda v, w: int(whole(v) @ whole(w)))
    assert got == {q: f for q, f in want.items() if f}
    assert mtree.exact_top(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_stored_bounds_avoid_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 4)) * 1000
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 4)) * 10).astype(np.int64)
    ids = rng.permutation(4000)
    tree = mtree.MTree(x, ids)
    for q in range(0, 4000, 100):
        found, scores, computed = tree.search(x[q], int(ids[q]), 10)
        other = ids != ids[q]
        s = x[other] @ x[q]
        at = top(s, ids[other], 10)
        assert found.tolist() == ids[other][at].tolist() and scores.tolist() == s[at].tolist()
        assert computed < 2000


def test_approximate_search_recall_and_exact_scores(vectors):
    rows = usable_rows(vectors, zeros=False)
    got = answers(ann.nearest(vectors, F.col("id") % 20 == 0, k=20))
    want = brute(rows, 20, 20, lambda v, w: float(v @ w))
    assert got.keys() == {q for q, f in want.items() if f}
    hits = total = 0
    by_id = dict(rows)
    for q, found in got.items():
        assert len(found) == len(want[q]) and q not in [j for j, _ in found]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - float(by_id[j] @ by_id[q])) < 1e-9 for j, s in found)
        floor = want[q][-1][1] - 1e-9  # of equal scores any is as near
        hits += sum(s >= floor for _, s in found)
        total += len(found)
    assert hits / total >= 0.9
    assert ann.nearest(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_recall_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = usable_rows(df, zeros=False)
    got = answers(ann.nearest(df, F.col("id") % 20 == 0, k=20))
    want = brute(rows, 20, 20, lambda v, w: float(v @ w))
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in f}) / len(f) for q, f in want.items()])
    assert recall >= 0.9
