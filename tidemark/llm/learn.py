"""What the trained operators share: folds, bounded samples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Labels that a sample is drawn from. With more, those of fewest rows teach nothing: a sample would hold hardly a row of each.
MOST_LABELS = 1000


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def _hash(of: tuple[str, ...], salt: str) -> Column:
    return F.xxhash64(F.lit(salt), *[F.col(c).cast("string") for c in of])


def _bound(share: float) -> int:
    """The largest 64-bit hash of the lowest ``share`` of all hashes, however small the share."""
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63) - 1) if share * 2.0**64 >= 1 else -(1 << 63)


def drawn(share: float, *of: str, salt: str = "sample") -> Column:
    """Whether the columns' hash is among the lowest ``share`` of all hashes."""
    return _hash(of, salt) <= F.lit(_bound(share))


def label_counts(df: DataFrame, label: str, *row: str) -> dict:
    """Rows by label, of the ``MOST_LABELS`` most frequent labels; with ``row``, about how many differ in these columns."""
    n = F.approx_count_distinct(F.xxhash64(*[F.col(c).cast("string") for c in row]), 0.02) if row else F.count(F.lit(1))
    found = df.groupBy(label).agg(n.alias("n")).filter(F.col(label).isNotNull() & (F.col("n") > 0))
    return {r[0]: r[1] for r in found.orderBy(F.desc("n"), label).limit(MOST_LABELS).collect()}


def _even(label: str, counts: dict, rows: int, *of: str, salt: str = "sample") -> Column:
    """Whether a row is drawn, if about ``rows`` are wanted, as many of each label as there are or its equal part."""
    if not counts:
        return F.lit(False)
    each = rows / len(counts)
    bounds = F.create_map(*[x for value, n in counts.items() for x in (F.lit(value), F.lit(_bound(each / n)).cast("long"))])
    return F.coalesce(_hash(of, salt) <= bounds[F.col(label)], F.lit(False))


def bounded(df: DataFrame, rows: int, *of: str) -> DataFrame:
    """``df`` stored. If it has more than 1.5 * ``rows`` + 100 rows, about ``rows`` are drawn from it by the hash of the
    columns, until the bound holds: so what is collected or broadcast next is known to be small."""
    kept, turn = materialize(df, "sample"), 0
    while (n := kept.count()) > 1.5 * rows + 100:
        turn += 1
        kept = materialize(kept.filter(drawn(rows / n, *of, salt=f"again {turn}")), "sample")
    return kept


def stratified(df: DataFrame, label: str, rows: int, *row: str) -> DataFrame:
    """About ``rows`` rows, as even over the labels as they allow, stored; never more than ``bounded`` says.

    Rows are drawn by the hash of the columns ``row`` (a key and a text, say), so that many rows of one key, or of
    none, are drawn like any others. Rows that agree in them and in the label count once.
    """
    chosen = df.filter(_even(label, label_counts(df, label, *row), rows, *row))
    return bounded(chosen.dropDuplicates([label, *row]), rows, *row)


def training_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, rows: int) -> tuple[DataFrame, dict]:
    """(text, label) of about ``rows`` labelled rows, even over the labels, and the counts of all labelled keys.

    The sample is drawn from the labels alone; its size is checked, and it is broadcast to the texts, which are
    not shuffled. If a drawn key has many texts, about as many of these are drawn as of the label are wanted. The result is stored for
    the passes of a fit. Repeated labels and texts count once. Null labels teach nothing; a null text is an empty one.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().distinct()
    counts = label_counts(known, "label")
    chosen = bounded(known.filter(_even("label", counts, rows, "key", "label")), rows, "key", "label")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    met = label_counts(texts.select("key").join(F.broadcast(chosen), "key"), "label")
    found = texts.join(F.broadcast(chosen), "key").filter(_even("label", met, int(1.2 * rows) + 1, "key", "text", salt="texts"))
    return bounded(found.dropDuplicates(["key", "label", "text"]), rows, "key", "text").select("text", "label"), counts


def platt(margin: np.ndarray, positive: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope (at least a small positive one) and offset of the logistic curve through margins and 0/1 outcomes."""
    if not len(margin) or positive.all() or not positive.any():
        return 1.0, 0.0
    n1, n0 = positive.sum(), (~positive).sum()
    goal = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(positive, 0.5 / n1, 0.5 / n0)
    scale = max(float(np.std(margin)), 1e-9)
    z, a, b = margin / scale, 1.0, 0.0
    for _ in range(steps):  # damped Newton steps on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-12
        grad = np.array([g @ z + 1e-4 * a, g.sum()])
        hess = np.array([[h @ (z * z) + 1e-4, h @ z], [h @ z, h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3) / scale, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
