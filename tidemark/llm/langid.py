"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its words' byte n-grams (3 to 5 bytes, word ends marked),
hashed into buckets; a linear layer and a softmax turn it into language probabilities. Both layers are
trained by stochastic gradient descent on a bounded sample, and a held-back part of it sets the softmax's
temperature, so that the score is the probability of being right. Texts below ``min_score`` are rejected.
Because average and linear layer commute, scoring needs only one row of logits per bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import stratified
from tidemark.llm.text import pieces, utf8

BUCKETS = 1 << 15
DIM = 16
ORDERS = (3, 4, 5)
UNKNOWN = "und"

_BREAK = np.array([not (chr(b).isalpha() or b >= 128) for b in range(256)])


def _subwords(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each byte; BUCKETS where none does.

    An n-gram lies in one word, and may hold the break before or after it as a mark.
    """
    gap = _BREAK[data]
    byte = np.where(gap, np.uint32(32), data).astype(np.uint32)
    for n in ORDERS:
        size = max(0, len(data) - n + 1)
        h = np.full(size, 2166136261 + n, dtype=np.uint32)
        broken = np.zeros(size, dtype=bool)
        for k in range(n):
            h = (h ^ byte[k : k + size]) * np.uint32(16777619)
            if 0 < k < n - 1:
                broken |= gap[k : k + size]
        h ^= h >> np.uint32(15)
        out = np.full(len(data), BUCKETS, dtype=np.int32)
        out[:size] = np.where(broken, BUCKETS, h & np.uint32(BUCKETS - 1))
        yield out


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Pieces of the lower-cased batch: bytes, and where each text begins and ends in them.

    Every text stands between breaks, so that no n-gram crosses from one text into the next.
    """
    gap, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(gap, pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), gap, none)
    data, offsets = utf8(padded)
    for i, j in pieces(offsets):
        at = (offsets[i : j + 1] - offsets[i]).tolist()
        yield data[offsets[i] : offsets[j]], at[:-1], at[1:]


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS + 1, languages); the last row, for no n-gram, is 0
    min_score: float = 0.4

    def scores(self, column: pa.Array) -> np.ndarray:
        """(rows, languages) probabilities; even ones for a text without n-grams."""
        out = []
        for data, starts, ends in _rows(column):
            total, count = np.zeros((len(starts), len(self.languages))), np.zeros(len(starts))
            for bucket in _subwords(data):
                # texts end in a break, so an n-gram that begins in the last bytes of a text is broken
                sums = np.add.reduceat(self.logits[bucket], starts, axis=0, dtype=np.float64)
                total += sums
                count += np.add.reduceat(bucket < BUCKETS, starts, dtype=np.int64)
            z = total / np.maximum(count, 1)[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, column: pa.Array) -> pa.Array:
        """struct<lang, score, accepted> of each text."""
        lettered = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        if self.languages:
            p = self.scores(column)
            best = p.argmax(axis=1)
            score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
            lang = np.where(lettered, np.array(self.languages, dtype=object)[best], UNKNOWN)
        else:
            score, lang = np.zeros(len(column)), np.full(len(column), UNKNOWN, dtype=object)
        accepted = lettered & (score >= self.min_score)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], names=["lang", "score", "accepted"])


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, each in as few bytes as the largest needs (1, 2, 4 or 8)."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_packed`` made ``data`` of."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n, gaps, counts): how many n-gram buckets a text has, the steps from each to the next, and how often each occurs.

    The driver gathers these. Most steps and counts fit one byte.
    """
    for batch in batches:
        sizes, gaps, counts = [], [], []
        for data, starts, ends in _rows(batch.column("text")):
            orders = list(_subwords(data))
            for a, b in zip(starts, ends, strict=True):
                found = np.bincount(np.concatenate([o[a:b] for o in orders]), minlength=BUCKETS + 1)[:BUCKETS]
                own = np.flatnonzero(found)
                sizes.append(len(own))
                gaps.append(_packed(np.diff(own, prepend=0)))
                counts.append(_packed(found[own]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(sizes, pa.int32()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], ["label", "n", "gaps", "counts"]
        )


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = 4000, epochs: int = 6, rate: float = 0.5, min_score: float = 0.4) -> LanguageModel:
    """Train on a sample of about ``rows`` labelled rows, as even over the languages as they allow.

    Rows with a null text or label teach nothing, and repeated rows count once. Without any, the model knows no language.
    """
    usable = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).dropna(subset=["text", "label"])
    sample = stratified(usable, "label", rows, "key", "text").select("text", "label").mapInArrow(_counted, "label string, n int, gaps binary, counts binary")
    got = sample.toArrow()
    labels = got["label"].to_pylist()
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), min_score)
    index = {x: i for i, x in enumerate(languages)}
    target = np.array([index[x] for x in labels])
    # Views of what Arrow holds: the features are in memory once.
    packed = [(n, g.as_buffer(), c.as_buffer()) for n, g, c in zip(got["n"].to_pylist(), got["gaps"], got["counts"], strict=True)]

    def counted(i: int) -> tuple[np.ndarray, np.ndarray]:
        n, gaps, counts = packed[i]
        return np.cumsum(_unpacked(gaps, n), dtype=np.uint16), _unpacked(counts, n).astype(np.uint32)

    # The order in which partitions answer must not change the model.
    order = sorted(range(len(packed)), key=lambda i: (target[i], hashlib.blake2b(b"".join(x.tobytes() for x in counted(i)), digest_size=8).digest()))
    random = np.random.default_rng(7)
    order = np.array(order)[random.permutation(len(order))]

    def features(i: int) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = counted(i)
        return buckets, (counts / max(1, counts.sum())).astype(np.float32)

    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    inputs = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output = np.zeros((DIM, len(languages)))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in random.permutation(train):
            bucket, weight = features(i)
            pace = rate * (1 - done / steps)
            done += 1
            hidden = weight @ inputs[bucket]
            z = hidden @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = output @ p
            output -= pace * np.outer(hidden, p)
            # every n-gram of the text moves the same way, in proportion to its share
            inputs[bucket] -= (pace * len(bucket)) * np.outer(weight, back)
    logits = inputs @ output
    sharp = _temperature([weights @ logits[b] for b, weights in map(features, held)], target[held])
    del got, packed
    pa.default_memory_pool().release_unused()
    return LanguageModel(languages, np.vstack([logits * sharp, np.zeros(len(languages))]).astype(np.float32), min_score)


def _temperature(logits: list[np.ndarray], target: np.ndarray) -> float:
    """The factor of the logits under which held-back rows are likeliest."""
    if not len(target):
        return 1.0
    z = np.array(logits)

    def loss(factor: float) -> float:
        s = z * factor
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target]))

    return min(np.geomspace(0.05, 20, 121), key=loss)


def predict(text: Column | str, model: LanguageModel) -> Column:
    """struct<lang string, score double, accepted boolean>.

    ``lang`` is ``und`` with score 0, not accepted, if the text is null or holds no letter; else it is the likeliest
    learned language, accepted if its calibrated probability reaches the model's ``min_score``. Equal texts get equal results.
    """

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def language(column: pa.Array) -> pa.Array:
        return model.predict(column)

    return language(F.col(text) if isinstance(text, str) else text)
