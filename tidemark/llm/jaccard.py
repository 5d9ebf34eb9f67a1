"""Exact n-gram Jaccard join by filtering under several global token orders.

Under any one order of all tokens, two sets with a Jaccard similarity of at least t share a token among
their first |s| - ceil(t |s|) + 1 tokens. So a pair that shares no such token under one of several orders is no
link, and only pairs that pass under all of them are verified on the whole sets. The orders put rare tokens
first and break ties by different hashes; the last one ranks coarser classes of frequency.

How it runs:

1. Each text becomes a set of shingle hashes; texts with equal sets are one class from here on.
2. Frequencies: tasks hash the tokens of some thousand documents at a time into ranges. A range counts its tokens over
   all documents and returns to each group of documents only tokens that occur elsewhere. A token that a group of documents
   holds several times is sent once, with its count, so a token of a third of all documents is no hot key.
   A set of which fewer than ceil(t |s|) tokens occur elsewhere cannot link and goes no further.
3. Stars: sets that lead with the same token under a hash order are compared with one of them. Of a
   large group of near copies nearly all is linked here, with few comparisons a set.
4. Rest: components whose sets share prefix tokens are compared, in blocks of sets that are filtered under every order
   and verified. Pairs inside a component need no look, as they change no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import mix, shingle_sets
from tidemark.session import materialize

#: Tokens a task gathers before it sends them on, and tokens a range is meant to hold.
GROUP_TOKENS = 500_000
RANGE_TOKENS = 1_000_000
#: Leading tokens by which stars are formed.
LEADS = 2
#: Sets of a block of the smaller and of the larger component, when components are compared.
ASKED_BLOCK = 128
MEMBER_BLOCK = 512
ORDER_SEEDS = (0x51ED270B, 0x2545F491, 0x9E3779B9)

_U = np.uint64
_SHARED = 0xFFFF  # stands for the document of a token that several documents of a group hold
_ROW = "bucket int, kind int, grp long, tokens binary, docs binary, counts binary"


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    place = np.arange(1, len(tokens) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return int(mix(np.array([mix(tokens ^ mix(place)).sum(dtype=_U) + _U(len(tokens))]))[0].astype(np.int64))


def describe_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, set): the size of each row's set and its hash; no hash for an empty one."""

    @F.arrow_udf("struct<n:bigint,id:bigint>")
    def described(column: pa.Array) -> pa.Array:
        found = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(column, width)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["n", "id"])

    return df.select(F.col(key).alias("key"), described(F.col(text)).alias("s")).select("key", F.col("s.n").alias("n_shingles"), F.col("s.id").alias("set"))


def pack_sorted(tokens: np.ndarray) -> bytes:
    """Sorted tokens as their steps, byte plane by byte plane: steps are small, so the high planes are zeros that
    the shuffle's compression takes out."""
    steps = np.diff(tokens.astype("<u8"), prepend=_U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U)


def _spread(ranges: int, width: int):
    """Tokens of groups of documents, dealt into ranges; each set once a group.

    A group's number tells its task, its place there and its sets in their order: a retry repeats it, and
    groups of other tasks that hold the same sets have numbers of their own.
    """

    def sent(task: int, place: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        group = set_id(np.array([task, place, *ids], dtype=np.int64).astype(_U))
        tokens, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(first, len(tokens)))
        several = np.repeat(count > 1, count)
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        yield group % ranges, 2, group, np.array(ids, dtype=np.int64).tobytes(), b"", sizes.tobytes()
        if several.any():
            yield group % ranges, 1, group, pack_sorted(tokens[several]), docs[several].tobytes(), b""
        tokens, docs = tokens[first], np.where(count > 1, np.uint16(_SHARED), docs[first]).astype(np.uint16)
        # ranges of hash values: contiguous in sorted tokens
        of = ((tokens >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        edges = np.searchsorted(of, np.arange(ranges + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield b, 0, group, pack_sorted(tokens[part]), docs[part].tobytes(), count[part][docs[part] == _SHARED].astype(np.uint32).tobytes()

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ("bucket", "kind", "grp", "tokens", "docs", "counts")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, None] = {}
        sets: list[np.ndarray] = []
        held = place = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if not len(s) or (i := set_id(s)) in ids:
                    continue
                ids[i] = None
                sets.append(s)
                held += len(s)
                if held >= GROUP_TOKENS or len(sets) == _SHARED:
                    yield as_batch(list(sent(task, place, list(ids), sets)))
                    ids, sets, held, place = {}, [], 0, place + 1
        if sets:
            yield as_batch(list(sent(task, place, list(ids), sets)))

    return spread


def _binary(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _count_range(rows: pa.Table) -> pa.Table:
    """Counts a range's tokens over all groups; returns to each group its tokens that occur elsewhere, with frequencies."""
    other = rows.filter(pc.greater(rows["kind"], 0))
    rows = rows.filter(pc.equal(rows["kind"], 0))
    out = []
    if len(rows):
        tokens, docs = [unpack_sorted(x) for x in rows["tokens"].to_pylist()], _binary(rows["docs"], np.uint16)
        weights = []
        for d, c in zip(docs, _binary(rows["counts"], np.uint32), strict=True):
            w = np.ones(len(d), dtype=np.uint32)
            w[d == _SHARED] = c
            weights.append(w)
        ends = np.cumsum([len(t) for t in tokens])
        order = np.argsort(np.concatenate(tokens), kind="stable")
        in_order = np.concatenate(tokens)[order]
        first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        del in_order
        total = np.add.reduceat(np.concatenate(weights)[order].astype(np.int64), first)
        # any function of the token orders all tokens alike; a logarithm needs two bytes, and 0 says: nowhere else
        level = np.minimum(np.round(np.log2(total) * 2048), 0xFFFF).astype(np.uint16)
        frequency = np.empty(len(order), dtype=np.uint16)
        frequency[order] = np.repeat(level, np.diff(np.append(first, len(order))))
        for g, t, d, end in zip(rows["grp"].to_pylist(), tokens, docs, ends.tolist(), strict=True):
            f = frequency[end - len(t) : end]
            keep = f > 0
            if keep.any():
                out.append((0, 0, g, pack_sorted(t[keep]), d[keep].tobytes(), f[keep].tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    found = pa.table([pa.array(c, k) for c, k in zip(columns, other.schema.types, strict=True)], schema=other.schema)
    return pa.concat_tables([other, found])


def _prefixes(tokens: np.ndarray, frequency: np.ndarray, n: int, t: float) -> list[np.ndarray]:
    """The tokens that occur elsewhere of the set's prefix under each order; those of no other set come first in all."""
    length = len(tokens) - math.ceil(t * n - 1e-9) + 1
    out = []
    for k, seed in enumerate(ORDER_SEEDS):
        rank = frequency if k < len(ORDER_SEEDS) - 1 else frequency // 2048
        order = np.lexsort((mix(tokens ^ _U(seed)), rank))
        out.append(tokens[order[:length]])
    return out


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token: sets that share a token share these, so a filter on them loses no pair."""
    return tokens.astype(np.uint32).astype(np.int32)


def _gather_group(t: float):
    """From what the ranges returned: the sets of a group that can link at all."""

    def gather(rows: pa.Table) -> pa.Table:
        kind = np.asarray(rows["kind"])
        tokens, docs, counts = rows["tokens"].to_pylist(), rows["docs"].to_pylist(), rows["counts"].to_pylist()
        table = int(np.flatnonzero(kind == 2)[0])
        ids, sizes = np.frombuffer(tokens[table], np.int64), np.frombuffer(counts[table], np.uint32)
        join = lambda parts, d: np.concatenate([np.frombuffer(p, d) for p in parts]) if parts else np.empty(0, d)
        back = np.flatnonzero(kind == 0)
        unpacked = lambda at: np.concatenate([unpack_sorted(tokens[i]) for i in at]) if len(at) else np.empty(0, _U)
        tok, (doc, freq) = unpacked(back), (join([x[i] for i in back], np.uint16) for x in (docs, counts))
        own = np.flatnonzero(kind == 1)
        own_tok, own_doc = unpacked(own), join([docs[i] for i in own], np.uint16)
        shared = doc == _SHARED
        known = np.argsort(tok[shared], kind="stable")
        at = known[np.searchsorted(tok[shared], own_tok, sorter=known)] if len(own_tok) else known[:0]
        tok, doc, freq = (np.concatenate(p) for p in ((tok[~shared], own_tok), (doc[~shared], own_doc), (freq[~shared], freq[shared][at])))
        order = np.lexsort((tok, doc))
        tok, doc, freq = tok[order], doc[order], freq[order].astype(np.int64)
        edges = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = []
        for k in range(len(ids)):
            r, f, n = tok[edges[k] : edges[k + 1]], freq[edges[k] : edges[k + 1]], int(sizes[k])
            if len(r) and len(r) >= math.ceil(t * n - 1e-9):
                leads = [int(mix(r ^ _U(seed)).min().astype(np.int64)) for seed in range(1, LEADS + 1)]
                a, b, c = _prefixes(r, f, n, t)
                out.append((int(ids[k]), n, len(r), r.tobytes(), a.astype(np.int64), _short(b), _short(c), leads))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        long, longs, ints = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = (long, long, long, pa.binary(), longs, ints, ints, longs)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["set", "n", "r", "tokens", "a", "b", "c", "leads"])

    return gather


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(u, v) of the pairs (u, v) that pass under all orders and whose whole sets are similar enough."""
    hundred = round(100 * t)
    b = sets.select("set", "b", "c")
    x, y = (b.select(F.col("set").alias(p), F.col("b").alias(f"b{p}"), F.col("c").alias(f"c{p}")) for p in ("u", "v"))
    passed = pairs.join(x, "u").join(y, "v").filter(F.arrays_overlap("bu", "bv") & F.arrays_overlap("cu", "cv")).select("u", "v")
    whole = sets.select("set", "n", "tokens")
    x, y = (whole.select(F.col("set").alias(p), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k, p in ((1, "u"), (2, "v")))
    passed = passed.join(x, "u").join(y, "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n1, n2, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "t1", "t2")), strict=True):
                common = len(np.intersect1d(np.frombuffer(t1, _U), np.frombuffer(t2, _U), assume_unique=True))
                keep.append(100 * common >= hundred * (n1 + n2 - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return passed.mapInArrow(verify, "u long, v long")


def _can_link(n1: Column, r1: Column, n2: Column, r2: Column, t: float) -> Column:
    """False where sizes alone rule a link out: what two sets share is at most the smaller one and at most the tokens
    of either that occur elsewhere, and a link needs (1 + t) * shared >= t * (n1 + n2)."""
    hundred = round(100 * t)
    return (100 + hundred) * F.least(n1, n2, r1, r2) >= hundred * (n1 + n2)


def _may_link(t: float) -> Column:
    """``_can_link`` for some members of two cells, from their smallest n, largest n (most) and largest r."""
    hundred = round(100 * t)
    shared = F.least("most1", "most2", "r1", "r2")
    near = (100 * F.col("most1") >= hundred * F.col("n2")) & (100 * F.col("most2") >= hundred * F.col("n1"))
    return near & ((100 + hundred) * shared >= hundred * (F.col("n1") + F.col("n2")))


def linked_sets(texts: DataFrame, ranges: int, width: int, t: float) -> DataFrame:
    """(node, component) of all sets that link with another one. ``texts`` has one column."""
    dealt = texts.mapInArrow(_spread(ranges, width), _ROW)
    counted = dealt.groupBy("bucket").applyInArrow(_count_range, _ROW)
    able = counted.groupBy("grp").applyInArrow(_gather_group(t), "set long, n long, r long, tokens binary, a array<long>, b array<int>, c array<int>, leads array<long>")
    sets = materialize(able.dropDuplicates(["set"]), "sets")

    # sets of about one size: a factor of 1.5, the classes of the second lead half a class off
    size_class = F.floor(F.log("n") / math.log(1.5) + F.col("k") / LEADS)
    leads = sets.select("set", "n", "r", F.posexplode("leads").alias("k", "lead")).withColumn("lead", F.xxhash64("lead", size_class))
    # of near copies the one with the most tokens that occur elsewhere is the least changed: most others are near it
    hubs = leads.groupBy("k", "lead").agg(F.max(F.struct("r", "n", "set")).alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    stars = (
        leads.join(hubs.select("k", "lead", F.col("hub.set").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.r").alias("hub_r")), ["k", "lead"])
        .filter((F.col("set") != F.col("hub")) & _can_link(F.col("n"), F.col("r"), F.col("hub_n"), F.col("hub_r"), t))
        .select(F.col("hub").alias("u"), F.col("set").alias("v"))
        .distinct()
    )
    links = materialize(_verified(stars, sets, t), "links")
    labels = components(links)

    marked = sets.join(labels, F.col("set") == F.col("node"), "left").select("set", "n", "r", F.coalesce("component", "set").alias("component"), F.col("node").isNotNull().alias("linked"), "a")
    postings = materialize(marked.select("set", "n", "r", "component", F.explode("a").alias("token")), "postings")
    mixed = postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    left = materialize(postings.join(mixed, "token", "left_semi"), "mixed")
    cells = left.groupBy("token", "component").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("r").alias("r"))
    one, two = (cells.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("component", "n", "most", "r")]) for k in (1, 2))
    apart = one.join(two, "token").filter((F.col("component1") < F.col("component2")) & _may_link(t)).select("component1", "component2").distinct()
    members = materialize(marked.drop("a"), "members")
    # Links between components join these, not sets: a small graph, whose nodes are the components' smallest sets.
    across = _across(apart, members, sets, t)
    for side in ("u", "v"):
        across = across.join(members.select(F.col("set").alias(side), F.col("component").alias(f"c{side}")), side)
    merged = components(across.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    joined = members.join(merged, members["component"] == merged["node"], "left").filter(F.col("linked") | F.col("node").isNotNull())
    return joined.select(F.col("set").alias("node"), F.coalesce(merged["component"], members["component"]).alias("component"))


def _across(apart: DataFrame, members: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(u, v) of the links between the components of each pair (component1, component2).

    The sets of the smaller component are compared with the larger one's in blocks, each of at most some hundred sets,
    so a component of any size is dealt out, and a pair of sets is no row.
    """
    hundred = round(100 * t)
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.max("n").alias("most"), F.max("r").alias("r"))
    one, two = (whole.select(*[F.col(c).alias(f"{c}{k}") for c in ("component", "m", "n", "most", "r")]) for k in (1, 2))
    turned = F.col("m1") > F.col("m2")
    sides = apart.join(one, "component1").join(two, "component2").filter(_may_link(t))
    sides = sides.select(*[F.when(turned, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"large_{c}") for c in ("component", "m", "n", "most", "r")], F.when(turned, F.col("component2")).otherwise(F.col("component1")).alias("component"))
    # a set goes on if it can link with some member: as small as the smallest, sharing as much as the largest
    able = (100 + hundred) * F.least("n", "r", "large_most", "large_r") >= hundred * (F.col("n") + F.col("large_n"))
    asked = sides.join(members, "component").filter(able).select(F.col("large_component").alias("into"), "large_m", "set")
    asked = materialize(asked, "asked")
    counts = asked.groupBy("into").agg(F.ceil(F.count(F.lit(1)) / ASKED_BLOCK).cast("int").alias("down"), F.ceil(F.first("large_m") / MEMBER_BLOCK).cast("int").alias("wide"))
    n = asked.count()
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 5000))

    def blocks(rows: DataFrame, own: str, of: str, others: str, kind: int) -> DataFrame:
        """Rows with their tokens, once for each block of the other side."""
        other = "y" if own == "x" else "x"
        placed = rows.join(counts, "into").withColumn(own, F.pmod(F.xxhash64("set"), F.col(of)).cast("int"))
        spread = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select("into", "x", "y", "set", F.lit(kind).alias("kind"))
        return spread.join(sets.select("set", "n", "tokens", "a", "b", "c"), "set")

    queries = blocks(asked.select("into", "set"), "x", "down", "wide", 0)
    targets = blocks(members.select(F.col("component").alias("into"), "set"), "y", "wide", "down", 1)
    both = queries.unionByName(targets).withColumn("task", F.pmod(F.xxhash64("into", "x", "y"), F.lit(tasks)))
    return both.groupBy("task").applyInArrow(_verify_blocks(t), "u long, v long")


class _Inverted:
    """Which of some arrays hold a token."""

    def __init__(self, arrays: list[np.ndarray]):
        tokens = np.concatenate(arrays)
        owner = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.size = tokens[order], owner[order], len(arrays)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """For each array, how many of the distinct ``tokens`` it holds."""
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        spans = [self.owner[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True) if i < j]
        return np.bincount(np.concatenate(spans), minlength=self.size) if spans else np.zeros(self.size, dtype=np.int64)


def _verify_blocks(t: float):
    hundred = round(100 * t)

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("into", "ascending"), ("x", "ascending"), ("y", "ascending"), ("kind", "ascending")]).combine_chunks()
        cell = np.stack([rows[c].to_numpy() for c in ("into", "x", "y")])
        edges = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0), [True]])) if len(rows) else np.zeros(1, int)
        u, v = [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = rows.slice(low, high - low)
            asked = int((part["kind"].to_numpy() == 0).sum())
            if not 0 < asked < len(part):
                continue
            ids, n = part["set"].to_numpy(), part["n"].to_numpy()
            tokens = [np.frombuffer(x, _U) for x in part["tokens"].to_pylist()]
            orders = [[np.array(x) for x in part[c].to_pylist()] for c in ("a", "b", "c")]
            filters, sets = [_Inverted(o[asked:]) for o in orders], _Inverted(tokens[asked:])
            for i in range(asked):
                # candidates share prefix tokens under every order
                passed = np.logical_and.reduce([f.shared(np.unique(o[i])) > 0 for f, o in zip(filters, orders, strict=True)])
                if not passed.any():
                    continue
                common = sets.shared(tokens[i])
                near = passed & (100 * common >= hundred * (n[i] + n[asked:] - common))
                for k in np.flatnonzero(near).tolist():
                    u.append(int(ids[i]))
                    v.append(int(ids[asked + k]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return verify


def _components_of_sets(df: DataFrame, described: DataFrame, text: str, width: int, t: float) -> DataFrame:
    """(set, first, component_id, kept): each set's smallest key, its component's, and the set that has the latter."""
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_TOKENS))
    firsts = described.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min("key").alias("first"))
    links = materialize(linked_sets(df.select(text), ranges, width, t), "components")
    named = links.join(firsts, F.col("node") == F.col("set")).select("node", "component", "first")
    leader = F.min(F.struct(F.col("first").isNull().alias("nil"), "first", "node")).alias("leader")
    least = named.groupBy("component").agg(leader)
    of_set = materialize(named.join(least, "component").select(F.col("node").alias("linked"), F.col("leader.first").alias("component_id"), F.col("leader.node").alias("kept")), "named")
    whole = firsts.join(of_set, F.col("set") == F.col("linked"), "left")
    linked = F.col("linked").isNotNull()
    return whole.select(
        F.col("set").alias("s"),
        "first",
        F.when(linked, F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
        F.when(linked, F.col("kept")).otherwise(F.col("set")).alias("kept"),
    )


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, t: float = 0.75) -> DataFrame:
    """(key, n_shingles, component_id): each row's set size and the smallest key reachable by links.

    * Rows link if 100 * intersection >= 100 t * union of their sets of ``width``-word shingles, A-Z lower-cased.
    * A text with fewer words is one shingle; null, empty and wordless texts have the empty set and link with nothing:
      their component is their own key. Rows with equal sets are always one component, however many.
    * Null keys are rows like any other; a component's key is its smallest one, and null only if it has no other.
    * Rows that repeat a key stay rows of their own. Other columns are left out. No rows give no rows.
    """
    described = materialize(describe_sets(df, key, text, width), "described")
    whole = _components_of_sets(df, described, text, width, t)
    filled, empty = described.filter(F.col("set").isNotNull()), described.filter(F.col("set").isNull())
    out = filled.join(whole, F.col("set") == F.col("s")).select("key", "n_shingles", "component_id")
    return out.unionByName(empty.select("key", "n_shingles", F.col("key").alias("component_id"))).withColumnRenamed("key", key)


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, t: float = 0.75) -> DataFrame:
    """All columns of ``df``, and of each component only one row: the one with its smallest key.

    Rows, links and special cases are those of ``similar_documents``: rows with the empty set all stay. Of rows that
    agree in the smallest key and in their sets one stays.
    """
    described = materialize(describe_sets(df, key, text, width), "described")
    whole = _components_of_sets(df, described, text, width, t)

    @F.arrow_udf("bigint")
    def set_of(column: pa.Array) -> pa.Array:
        return pa.array([set_id(s) if len(s) else None for s in shingle_sets(column, width)], pa.int64())

    # Copies go by their keys, so a set of many copies is dealt out; rows without a set meet no other row and go by key as well.
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    rows = df.withColumn("__llm_set", set_of(F.col(text))).withColumn("__llm_name", name).withColumn("__llm_at", F.coalesce("__llm_set", F.xxhash64(F.lit("empty"), F.col(key))))
    first = F.coalesce(F.concat(F.lit("k"), F.col("first").cast("string")), F.lit("n"))
    kept = whole.filter(F.col("s") == F.col("kept")).select(F.col("s").alias("__llm_kept"), first.alias("__llm_first"))
    met = rows.join(kept, (F.col("__llm_name") == F.col("__llm_first")) & (F.col("__llm_at") == F.col("__llm_kept")), "left")
    met = met.filter(F.col("__llm_set").isNull() | F.col("__llm_kept").isNotNull())
    again = F.row_number().over(Window.partitionBy("__llm_name", "__llm_at").orderBy(F.col(key)))
    return met.withColumn("__llm_again", again).filter(F.col("__llm_set").isNull() | (F.col("__llm_again") == 1)).select(*[F.col(c) for c in df.columns])
