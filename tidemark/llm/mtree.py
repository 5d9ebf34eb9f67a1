"""Exact largest integer inner products by best-first search of M-trees.

Vectors are lifted to one sphere, where the distance d from a query q to a vector x obeys
d^2 = |q|^2 + M^2 - 2 q.x with M^2 the largest squared norm: a metric in which the largest inner product is the
nearest vector. A block's M-tree has pages of entries. An entry of an inner page is a routing vector with its covering
radius, its distance to the page's own routing vector and the page below; a leaf entry is a vector with that distance.
A search takes the page with the smallest possible distance first. An entry whose stored distance to its
parent already shows, by the triangle inequality, that nothing below it can be near enough is passed over
without computing a distance. Bounds are floating-point with a margin, scores are exact integers, so results are exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import best, in_blocks, matrix, top, usable

PAGE = 64
FANOUT = 16


@dataclass
class Page:
    rows: np.ndarray  # positions of the entries' vectors
    to_parent: np.ndarray  # distances of the entries to the page's routing vector
    radii: np.ndarray | None = None  # covering radii; None in a leaf
    below: list[int] | None = None


class MTree:
    """A bulk-loaded M-tree over integer vectors; ``ids`` break ties and name a query's own rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.vectors, self.ids, self.page, self.fanout = vectors, ids, page, fanout
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.largest = int(self.squares.max(initial=0))
        self.lifted = np.hstack([vectors.astype(float), np.sqrt((self.largest - self.squares).astype(float))[:, None]])
        self.margin = 1e-6 * (1 + np.sqrt(float(self.largest)))
        self.pages: list[Page] = []
        everything = np.arange(len(vectors))
        self.root = self._build(everything, 0) if len(vectors) else -1

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        gap = self.lifted[rows] - self.lifted[pivot]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _build(self, rows: np.ndarray, parent: int) -> int:
        """Pages over ``rows``, whose routing vector is ``parent``."""
        if len(rows) > self.page:
            parts = self._split(rows)
            if len(parts) > 1:
                pivots = np.array([p for p, _ in parts])
                radii = np.array([self._distances(own, p).max() for p, own in parts])
                below = [self._build(own, int(p)) for p, own in parts]
                self.pages.append(Page(pivots, self._distances(pivots, parent), radii, below))
                return len(self.pages) - 1
        self.pages.append(Page(rows, self._distances(rows, parent)))
        return len(self.pages) - 1

    def _split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Up to ``fanout`` routing vectors far from each other, each with the rows nearest to it.

        Equal vectors cannot be told apart; a set of nothing else stays one page.
        """
        pivots, nearest, owner = [int(rows[0])], self._distances(rows, int(rows[0])), np.zeros(len(rows), dtype=int)
        while len(pivots) < self.fanout:
            far = int(nearest.argmax())
            if nearest[far] <= self.margin:
                break
            pivots.append(int(rows[far]))
            d = self._distances(rows, pivots[-1])
            closer = d < nearest
            owner[closer], nearest[closer] = len(pivots) - 1, d[closer]
        return [(p, rows[owner == k]) for k, p in enumerate(pivots) if (owner == k).any()]

    def search(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact scores of the ``k`` best, and the number of distances computed."""
        ids, scores, computed = np.empty(0, np.int64), np.empty(0, np.int64), 0
        if self.root < 0:
            return ids, scores, computed
        square = int(query @ query)
        lifted = np.append(query.astype(float), 0.0)
        reach = np.inf

        def distances(rows: np.ndarray) -> np.ndarray:
            gap = self.lifted[rows] - lifted
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        # the root page has no routing vector of its own: nothing is passed over there
        queue = [(0.0, self.root, None)]
        while queue:
            bound, number, from_parent = heapq.heappop(queue)
            if bound > reach + self.margin:
                break
            page = self.pages[number]
            rows = page.rows
            slack = 0.0 if page.radii is None else page.radii
            if from_parent is None or not np.isfinite(reach):
                open_ = np.arange(len(rows))
            else:
                open_ = np.flatnonzero(np.abs(from_parent - page.to_parent) - slack <= reach + self.margin)
            if not len(open_):
                continue
            computed += len(open_)
            if page.radii is None:
                at = rows[open_]
                at = at[self.ids[at] != own_id]
                new = self.vectors[at] @ query
                if len(scores) == k:
                    at, new = at[new >= scores[-1]], new[new >= scores[-1]]
                    if not len(at):
                        continue
                ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, new])
                keep = top(scores, ids, k)
                ids, scores = ids[keep], scores[keep]
                if len(scores) == k:
                    reach = float(np.sqrt(max(0, square + self.largest - 2 * int(scores[-1]))))
            else:
                d = distances(rows[open_])
                for e, distance in zip(open_.tolist(), d.tolist(), strict=True):
                    nearest = max(bound, distance - page.radii[e])
                    if nearest <= reach + self.margin:
                        heapq.heappush(queue, (nearest, page.below[e], distance))
        return ids, scores, computed


def exact_top(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products of floor(scale * x) vectors, exactly.

    * Queries are the rows for which ``is_query`` (of ``id``) holds; candidates all rows but those of the query's id.
    * Vectors that are null or hold null or non-finite components take no part, nor do rows without id; zero vectors do.
    * Ties go to the smaller id; a query with fewer candidates gets all of them. Rows that repeat an id are candidates
      of their own. Vectors are compared with those of their own length. No rows, or no queries, give no rows.
    """
    data = usable(df, key, vector)
    queries = data.filter(is_query)

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        asks: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        if len(rows) and len(asked):
            tree = MTree(np.floor(scale * matrix(rows["v"])).astype(np.int64), rows["id"].to_numpy())
            for a, q in zip(asked["id"].to_numpy(), np.floor(scale * matrix(asked["v"])).astype(np.int64), strict=True):
                i, s, _ = tree.search(q, int(a), k)
                asks.append(np.full(len(i), a, dtype=np.int64))
                ids.append(i)
                scores.append(s)
        empty = [np.empty(0, np.int64)]
        return pa.table({"query_id": np.concatenate(asks or empty), "vec_id": np.concatenate(ids or empty), "score": np.concatenate(scores or empty)})

    found = in_blocks(data, queries, search, "query_id long, vec_id long, score long")
    return best(found, k, F.col("score")).select("query_id", "rank", "vec_id", "score")
