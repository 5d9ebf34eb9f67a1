"""Vectorised views of a text column inside an Arrow batch: bytes, words and their hashes.

Every helper looks at whole texts. A batch is worked through in pieces of about ``PIECE_BYTES``
so that the scratch arrays stay small whatever the batch holds; one longer text is a piece alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE_BYTES = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE_MIX = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most ``rows`` texts at a time: texts are large rows, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    arr = column.cast(pa.large_string()).fill_null("")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of other bytes than 0x20, 0x09-0x0D), and each row's first word."""
    n = len(data)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges from one pass of prefix sums over the piece."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_MIX[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its ``width``-word shingles, A-Z lower-cased.

    With fewer words the whole sequence is one shingle; without words or text the set is empty.
    """
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = lower_ascii(data[offsets[i] : offsets[j]])
        starts, ends, first = word_bounds(part, at)
        words = span_hashes(part, starts, ends)
        many = max(0, len(words) - width + 1)
        rolled = np.zeros(many, dtype=_U)
        for k in range(width):
            rolled = mix(rolled * _U(_P) + words[k : k + many])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = np.full(1, b - a, dtype=_U)
                for w in words[a:b]:
                    h = mix(h * _U(_P) + w)
                yield h
            else:
                yield np.empty(0, dtype=_U)
