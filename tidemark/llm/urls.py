"""URL filter: host and path rules, and for what no rule names a logistic regression on hashed character n-grams.

The model reads the n-grams (2 to 4 characters, ends marked) of the host's labels and of the path, hashed into
buckets, and is trained from a small table of labelled URLs by accelerated gradient steps on the regularised likelihood. Digits
all count as 0, so that a page's number says nothing about it. Scoring sums one weight an n-gram; URLs are never shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import sigmoid

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Characters worked on at once; a longer URL is a piece alone.
PIECE = 1 << 18
#: Labelled rows that a fit accepts: they are held by the driver.
MOST_LABELLED = 100_000

ALLOW, BLOCK = "allow", "block"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """struct<name, verdict> of the longest rule that fits, or null; of equally long ones the blocking one, then the first by name."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == BLOCK, [-ord(c) for c in r.name])):
        found = F.when(rule.fits(host, path), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _pieces(hosts: list[str], paths: list[str]) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if held and held + len(h) + len(p) > PIECE:
            yield i, j
            i, held = j, 0
        held += len(h) + len(p) + 4
    if i < len(hosts):
        yield i, len(hosts)


def _features(values: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the marked strings: 1 begins, 2 ends, digits are 0. No n-gram crosses rows."""
    marked = [f"\x01{v}\x02" for v in values]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[(codes >= ord("0")) & (codes <= ord("9"))] = ord("0")
    row = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    rows, buckets = [], []
    for n in ORDERS:
        size = max(0, len(codes) - n + 1)
        h = np.full(size, 0x811C9DC5 + 2 * n + side, dtype=np.uint32)
        for k in range(n):
            h = (h ^ codes[k : k + size].astype(np.uint32)) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        whole = row[:size] == row[n - 1 : n - 1 + size]
        rows.append(row[:size][whole])
        buckets.append((h & np.uint32(BUCKETS - 1)).astype(np.int64)[whole])
    return np.concatenate(rows), np.concatenate(buckets)


def _shares(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share) of all n-grams; a host's shares sum up to 1, and so do a path's."""
    out = []
    for side, values in enumerate((hosts, paths)):
        rows, buckets = _features(values, side)
        many = np.bincount(rows, minlength=len(values))
        out.append((rows, buckets, 1 / many[rows]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        out = [np.zeros(0)]
        for i, j in _pieces(hosts, paths):
            rows, buckets, shares = _shares(hosts[i:j], paths[i:j])
            out.append(np.bincount(rows, self.weights[buckets] * shares, minlength=j - i) + self.bias)
        return sigmoid(np.concatenate(out))


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", strength: float = 2e-5, steps: int = 3000) -> UrlModel:
    """A model from a small table of URLs labelled 1 (block) or 0 (allow).

    * Rows with a null URL or label teach nothing, and equal rows count once. Classes weigh the same, however many rows they have.
    * The table is held by the driver; more than ``MOST_LABELLED`` rows are an error. With rows of one class every URL
      scores that class's side, without rows one half.
    """
    known = labelled.filter(F.col(url).isNotNull()).select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(label).cast("int").alias("label")).dropna().distinct()
    rows = sorted(tuple(r) for r in known.limit(MOST_LABELLED + 1).collect())
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    y = np.array([r[2] > 0 for r in rows], dtype=float)
    if y.all() or not y.any():
        return UrlModel(np.zeros(BUCKETS), float(2 * y.mean() - 1) if len(rows) else 0.0)
    at, buckets, shares = _shares([r[0] for r in rows], [r[1] for r in rows])
    cost = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    # A row's squared length is 3 at most (host, path, bias) and costs sum up to 1, which bounds the curvature.
    pace = 1 / (0.75 + strength)
    point = ahead = np.zeros(BUCKETS + 1)
    t = 1.0
    for _ in range(steps):  # accelerated gradient steps on all rows
        margin = np.bincount(at, ahead[buckets] * shares, minlength=len(rows)) + ahead[-1]
        back = cost * (sigmoid(margin) - y)
        slope = np.append(np.bincount(buckets, back[at] * shares, minlength=BUCKETS), back.sum()) + strength * np.append(ahead[:-1], 0)
        new = ahead - pace * slope
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        point, ahead = new, new + (last - 1) / t * (new - point)
        if np.abs(slope).max() < 1e-8:
            break
    return UrlModel(point[:-1], float(point[-1]))


def judge(df: DataFrame, model: UrlModel, rules: Iterable[Rule] = (), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``df``, with host, path, rule, score and verdict (``allow`` or ``block``).

    * The longest rule that fits decides; else a URL is blocked if its score reaches ``threshold``. ``rule`` is null then.
    * A null URL, and one without ``://``, has an empty host and path, which no rule fits and the model judges like any other.
    * Rows are judged alone: repeated rows get the same result. Columns of ``df`` with one of the new names are replaced.
      No rows give no rows. ``rules`` are part of the plan, so they should be few; URLs may be of any number and length.
    """

    @F.arrow_udf("double")
    def blocked(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(model.scores(hosts.to_pylist(), paths.to_pylist()), pa.float64())

    new = ("host", "path", "rule", "score", "verdict")
    base = df.select(*[c for c in df.columns if c not in new or c == url], host_of(F.col(url)).alias("__llm_host"), path_of(F.col(url)).alias("__llm_path"))
    found = base.select("*", rule_of(F.col("__llm_host"), F.col("__llm_path"), rules).alias("__llm_rule"), blocked("__llm_host", "__llm_path").alias("__llm_score"))
    own = F.when(F.col("__llm_score") >= threshold, BLOCK).otherwise(ALLOW)
    return found.select(
        *[c for c in df.columns if c not in new],
        F.col("__llm_host").alias("host"),
        F.col("__llm_path").alias("path"),
        F.col("__llm_rule.name").alias("rule"),
        F.col("__llm_score").alias("score"),
        F.coalesce("__llm_rule.verdict", own).alias("verdict"),
    )
