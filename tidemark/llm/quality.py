"""Quality scores by naive-Bayes support vectors on n-gram indicators.

An indicator says that an n-gram occurs in a text. N-grams are taken over four readings of the text: the
shapes of its bytes (runs of capitals, small letters, digits and spaces, and each other mark by itself),
which words equal the word before, the lengths of its words, and its lower-cased words. Junk shows in the first
three whatever its words are. Every indicator is scaled by its class log-count ratio; a linear
hinge-loss model over the scaled indicators is then fitted by dual coordinate descent, and mixed with its mean
weight as usual for this model. Both use one bounded sample, even over the classes: n-grams that fewer than two
of its rows hold weigh 0, however many other labelled rows hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import platt, sigmoid, training_sample
from tidemark.llm.text import lower_ascii, pieces, span_hashes, utf8, word_bounds

BUCKETS = 1 << 16

_SHAPE = np.arange(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or "a" <= _c <= "z":
        _SHAPE[_b] = ord("a")
    elif "A" <= _c <= "Z":
        _SHAPE[_b] = ord("A")
    elif "0" <= _c <= "9":
        _SHAPE[_b] = ord("0")
    elif _b in (0x20, 0x09, 0x0D):
        _SHAPE[_b] = ord(" ")
_RUNS = np.isin(np.arange(256), [ord(c) for c in "aA0 "])


def _hashed(stream: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Buckets of the n-grams of a stream of small numbers."""
    size = max(0, len(stream) - n + 1)
    h = np.full(size, (seed * 2654435761 + n) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h = (h ^ stream[k : k + size].astype(np.uint32)) * np.uint32(0x01000193)
        h ^= h >> np.uint32(13)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row the sorted distinct buckets of the whole text's n-grams; none for null and empty texts."""
    data, offsets = utf8(column)
    seen = np.zeros(BUCKETS, dtype=bool)
    for i, j in pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        shape = _SHAPE[part]
        keep = np.ones(len(part), dtype=bool)
        keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
        begins = at[:-1][at[:-1] < at[1:]]
        keep[begins] = True
        kept = np.flatnonzero(keep)
        shape, shape_at = shape[kept], np.searchsorted(kept, at)
        starts, ends, first = word_bounds(part, at)
        words = span_hashes(lower_ascii(part), starts, ends)
        again = np.zeros(len(words), dtype=np.uint8)
        again[1:] = words[1:] == words[:-1]
        long = np.minimum(ends - starts, 40).astype(np.uint8)
        long = np.where(long > 12, 12 + (long - 12) // 4, long)
        whole = (words >> np.uint64(48)).astype(np.int32)
        streams = [(shape, shape_at, (1, 2, 3, 4), 1), (again, first, (2, 3, 4), 2), (long, first, (1, 2), 3)]
        grams = [(_hashed(s, n, seed), s_at, n) for s, s_at, orders, seed in streams for n in orders]
        for k in range(j - i):
            seen[whole[first[k] : first[k + 1]]] = True
            for buckets, s_at, n in grams:
                seen[buckets[s_at[k] : max(s_at[k], s_at[k + 1] - n + 1)]] = True
            found = np.flatnonzero(seen)
            yield found.astype(np.int32)
            seen[found] = False


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, column: pa.Array) -> np.ndarray:
        margin = np.array([self.weights[f].sum() for f in indicators(column)]) + self.bias
        return sigmoid(self.slope * margin + self.offset)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class in which a bucket occurs, summed over a task."""
    counts, docs = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches:
        labels = np.asarray(batch.column("label")).astype(bool).astype(int)
        for y, found in zip(labels, indicators(batch.column("text")), strict=True):
            counts[y, found] += 1
            docs[y] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1).astype(np.int32)), *(pa.array(np.append(counts[y, used], docs[y])) for y in (0, 1))], ["bucket", "zeros", "ones"]
    )


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(indicators(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "buckets"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised squared-hinge model over scaled indicators.

    Each step solves one row's dual variable exactly; ``cost`` is the row's penalty. The bias is the weight of a
    constant input of 1.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    diagonal = 0.5 / cost
    squares = np.array([scale[f] @ scale[f] + 1 for f in rows]) + diagonal
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            f = rows[i]
            x = scale[f]
            slack = y[i] * (w[f] @ x + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slack / squares[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                bias += step
                worst = max(worst, abs(new - alpha[i]) * squares[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = 12000, smoothing: float = 1.0, cost: float = 0.1, blend: float = 0.5, epochs: int = 12) -> QualityModel:
    """Fit on a sample of about ``rows`` labelled rows, even over the classes.

    Rows with a null label teach nothing; a null text is an empty one. With rows of one class or none,
    every score is that class's smoothed share (0.5 without rows).
    """
    usable, _ = training_sample(documents, labels, text, label, key, rows)
    counted = usable.mapInArrow(_class_counts, "bucket int, zeros bigint, ones bigint")
    table = counted.groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    bucket = table["bucket"].to_numpy()
    docs = [int(table[c].to_numpy()[bucket < 0].sum()) for c in ("zeros", "ones")]
    if not all(docs):
        share = (docs[1] + 1) / (sum(docs) + 2)
        return QualityModel(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.zeros((2, BUCKETS))
    for y, c in enumerate(("zeros", "ones")):
        counts[y, bucket[bucket >= 0]] = table[c].to_numpy()[bucket >= 0]
    likely = [(counts[y] + smoothing) / (counts[y].sum() + smoothing * BUCKETS) for y in (0, 1)]
    ratio = np.log(likely[1] / likely[0])
    ratio[counts.sum(axis=0) < 2] = 0  # of one row only: says nothing of another
    got = usable.mapInArrow(_sampled, "label int, buckets array<int>").toArrow()
    examples = sorted(((int(y), np.asarray(b.values)) for y, b in zip(got["label"].to_pylist(), got["buckets"], strict=True)), key=lambda e: (e[0], e[1].tobytes()))
    order = np.random.default_rng(11).permutation(len(examples))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    sign = np.array([1.0 if y else -1.0 for y, _ in examples])
    rows_of = [f for _, f in examples]
    share = np.array([(sign[train] == s).mean() for s in (-1.0, 1.0)])
    penalty = cost / (2 * np.maximum(share, 1e-6))[(sign[train] > 0).astype(int)]
    w, bias = dual_coordinate_descent([rows_of[i] for i in train], ratio, sign[train], penalty, epochs)
    w = ((1 - blend) * np.abs(w).mean() + blend * w) * ratio
    bias *= blend
    margin = np.array([w[rows_of[i]].sum() + bias for i in held])
    slope, offset = platt(margin, sign[held] > 0)
    return QualityModel(w, bias, slope, offset)


def score(text: Column | str, model: QualityModel) -> Column:
    """The probability of label 1, with both labels taken as equally frequent; null and empty texts have no n-grams and get the score of the bias alone."""

    @F.arrow_udf("double")
    def quality_score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column))

    return quality_score(F.col(text) if isinstance(text, str) else text)
