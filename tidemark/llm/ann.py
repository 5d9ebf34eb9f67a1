"""Approximate largest inner products by collision-counting hashing.

Vectors are lifted to one sphere (a last component fills them up to the largest norm), where the largest inner
product is the smallest distance. Each hash function is a single random projection, kept as one sorted
array. A query opens a window around its own projection in every array, and widens all windows together by a
factor: that rehashes virtually at a larger radius, without other tables. A vector that lies in at least
``threshold`` of the windows collides often enough to be verified by its exact inner product. A query stops at
the first radius at which ``k + share * rows`` vectors have been verified; all that reach the threshold at
that radius are, so equal vectors stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import best, in_blocks, matrix, top, usable

PROJECTIONS = 112
THRESHOLD = 0.8
SHARE = 0.15
WIDEN = 1.15
SEED = 20240703
#: Queries whose windows are looked up together.
TOGETHER = 256


class CollisionIndex:
    """Sorted single-projection arrays over one block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.reach = float(np.sqrt(norms.max(initial=0.0)))
        lift = np.sqrt(np.maximum(self.reach**2 - norms, 0.0))
        axes = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1] + 1))
        shadows = np.ascontiguousarray((vectors @ axes[:, :-1].T + lift[:, None] * axes[:, -1]).T)
        self.axes = axes
        order = np.argsort(shadows, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shadows, order, axis=1)
        # place[j, x]: where vector x stands in array j
        self.place = np.empty(order.shape, dtype=np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=self.place.dtype)[None, :], axis=1)
        # the first windows hold about a tenth of a typical array, the last one everything
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) if len(vectors) else 0.0
        first = max(spread / 20, 1e-12)
        widest = 2 * float(np.abs(shadows).max(initial=0.0)) + 2 * self.reach * float(np.linalg.norm(axes, axis=1).max()) + first
        self.radii = first * WIDEN ** np.arange(int(np.ceil(np.log(widest / first) / np.log(WIDEN))) + 1)

    def search(self, queries: np.ndarray, k: int, threshold: float = THRESHOLD, share: float = SHARE) -> Iterator[np.ndarray]:
        """For each query the positions of its verified vectors."""
        for at in range(0, len(queries), TOGETHER):
            yield from self._search(queries[at : at + TOGETHER], k, threshold, share)

    def _search(self, queries: np.ndarray, k: int, threshold: float, share: float) -> list[np.ndarray]:
        """The windows of a query open at the radius at which the one before it stopped, and are widened or narrowed
        radius by radius to the first at which enough vectors are verified."""
        n, enough = len(self.vectors), int(np.ceil(threshold * len(self.place)))
        wanted = min(n, k + int(np.ceil(share * n)))
        lengths = np.linalg.norm(queries, axis=1)
        centres = ((queries * (self.reach / np.maximum(lengths, 1e-300))[:, None]) @ self.axes[:, :-1].T).T
        windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def colliding(i: int, t: int) -> np.ndarray:
            """Vectors that lie in enough of the query's windows at one radius."""
            if t not in windows:  # for all queries at once
                low = np.stack([np.searchsorted(a, c, "left") for a, c in zip(self.sorted, centres - self.radii[t], strict=True)])
                high = np.stack([np.searchsorted(a, c, "right") for a, c in zip(self.sorted, centres + self.radii[t], strict=True)])
                windows[t] = low.astype(self.place.dtype), (high - low).astype(self.place.dtype)
            low, width = windows[t]
            # unsigned: places before the window wrap around to large numbers
            inside = (self.place - low[:, i, None]) < width[:, i, None]
            return np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16) >= enough)

        out, t, last = [], 0, len(self.radii) - 1
        for i in range(len(queries)):
            found = colliding(i, t)
            while len(found) < wanted and t < last:
                t += 1
                found = colliding(i, t)
            while t > 0 and len(smaller := colliding(i, t - 1)) >= wanted:
                t, found = t - 1, smaller
            out.append(found)
        return out


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products found, in double precision.

    * Queries are the rows for which ``is_query`` (of ``id``) holds; candidates all rows but those of the query's id.
    * Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id.
    * Ties go to the smaller id; a query with fewer candidates gets all of them. Rows that repeat an id are candidates
      of their own. Vectors are compared with those of their own length. No rows, or no queries, give no rows.
    """
    data = usable(df, key, vector).filter(F.exists("v", lambda x: x != 0))
    queries = data.filter(is_query)

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, asks = rows["id"].to_numpy(), asked["id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(asks):
            x, q = matrix(rows["v"]), matrix(asked["v"])
            # one more than k: the query itself may be among them
            for a, v, at in zip(asks, q, CollisionIndex(x).search(q, k + 1, threshold, share), strict=True):
                at = at[ids[at] != a]
                scores = x[at] @ v
                keep = top(scores, ids[at], k)
                found.append((np.full(len(keep), a), ids[at][keep], scores[keep]))
        parts = [np.concatenate(c) if found else np.empty(0) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(float))})

    found = in_blocks(data, queries, search, "query_id long, vec_id long, score double")
    return best(found, k, F.col("score")).select("query_id", "rank", "vec_id", "score")
