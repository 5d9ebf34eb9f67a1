"""Text operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, jaccard, langid, lines, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, `__x` string, slot long, taken long, score double, component_id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    passage = "\n".join(line(12) for _ in range(9))
    out = [None, "", " \n\t ", "x", "X y", "one\n\ntwo\n", "\n", "a\nb\na\nb\na\nb", "Ünï cödé ΑΣ İ 　x <|endoftext|> it's 12'll", "same words here now again", "same words here now again"]
    out += [f"{line(30)}\n{passage}\n{line(20)}" for _ in range(4)] + [passage, passage]
    base = [word() for _ in range(200)]
    for k in range(12):
        out.append(" ".join(w if rng.random() > 0.01 * (k % 3) else word() for w in base))
    out.append("\n".join(line(10) for _ in range(3000)))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i, t, "en", ("b", "a", None, "c", "c")[i % 5], len(t or ""), 7, 1, "x", 9, 9, 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[15], (None, "null key text of six words", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(df):
    return df.limit(0)


# --- line chunks


def deduped(rows, divisor=8, min_chars=20, long_line=120):
    """Plain version: {(doc_id, text): (kept text, removed lines)}."""
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:6], 16)
    where, gone = defaultdict(list), defaultdict(set)
    for i, t in set(rows):
        if t is None:
            continue
        ls, digest = t.split("\n"), hashlib.md5(t.encode()).hexdigest()
        cuts = [k for k in range(1, len(ls)) if (h(ls[k]) + 31 * h(ls[k - 1])) % divisor or h(ls[k]) == h(ls[k - 1])]
        spans = [(k, k) for k, line in enumerate(ls) if len(line) >= long_line]
        pairs = [(k - 1, k) for k in cuts] + [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, len(ls)], strict=True) if b - a > 1]
        for a, b in spans + [(a, b) for a, b in pairs if len("\n".join(ls[a : b + 1])) >= min_chars]:
            where["\n".join(ls[a : b + 1])].append(((i is None, i, digest, a), b, (i, t)))
    for found in where.values():
        first = min(x[0] for x in found)
        for place, b, row in found:
            if place != first:
                gone[row] |= set(range(place[3], b + 1))
    out = {}
    for r in set(rows):
        if r[1] is not None:
            drop = gone[r]
            out[r] = "\n".join(line for k, line in enumerate(r[1].split("\n")) if k not in drop), len(drop)
    return out


def test_line_chunks_match_the_plain_version(odd):
    out = lines.dedup_lines(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = deduped(rows)
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.text, r.removed_lines) for r in out) == Counter((i, *want.get((i, t), (t, 0))) for i, t in rows)
    assert sum(r.removed_lines for r in out) > 20
    assert all(r.n_lines == 0 for r in out if r.text is None)
    assert lines.dedup_lines(empty(odd)).count() == 0


def test_a_moved_passage_is_cut_at_the_same_places(spark):
    passage = [f"line {k} of the passage" for k in range(40)]
    df = spark.createDataFrame([(1, "\n".join(["intro"] + passage)), (2, "\n".join(["another", "start", "here"] + passage + ["end"]))], "doc_id long, text string")
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert out[1].removed_lines == 0
    assert out[2].removed_lines >= 39 and out[2].text.startswith("another\nstart\nhere") and out[2].text.endswith("end")


def test_most_repeats_of_short_and_long_passages_are_removed(spark):
    """Judged by a version that knows no chunks: later lines of passages planted three times between lines of their own."""
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4))
    for size in (2, 4, 6, 12):
        passages = [[line() for _ in range(size)] for _ in range(100)]
        docs = [(c * 100 + k, "\n".join([line() for _ in range(rng.randint(0, 4))] + p + [line() for _ in range(rng.randint(0, 4))])) for c in range(3) for k, p in enumerate(passages)]
        own = {x for _, t in docs for x in t.split("\n")} - {x for p in passages for x in p}
        out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sum(r.removed_lines for r in out) >= 0.94 * 2 * 100 * size
        assert sum(x in own for r in out for x in r.text.split("\n")) == sum(x in own for _, t in docs for x in t.split("\n"))
        assert {x for p in passages for x in p} <= {x for r in out if r.doc_id < 100 for x in r.text.split("\n")}


def test_repeats_inside_texts_and_long_single_lines(spark):
    long = "word " * 60
    texts = [f"a\n{long}\nb", f"c\n{long}", "same line here it is\n" * 50 + "end", "short\n" * 3 + "x", "x\n\n\n\ny", "z\n\n\n\ny", "\n".join(f"{k} of many lines" for k in range(60_000))]
    rows = list(enumerate(texts)) + [(6, texts[6]), (7, texts[6])]
    out = sorted(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert Counter((r.doc_id, r.text, r.removed_lines) for r in out) == Counter((i, *deduped(rows)[i, t]) for i, t in rows)
    assert [r.removed_lines for r in out] == [0, 1, 49, 0, 0, 0, 0, 0, 60_000]
    assert out[2].text == "same line here it is\nend"


def test_units_of_one_hash_and_different_texts_are_told_apart(spark):
    rows = [("a", 0, 1, 5, "one"), ("b", 0, 1, 5, "two"), ("c", 2, 3, 5, "one"), ("d", 0, 1, 6, "three"), ("e", 1, 2, 6, "three"), ("f", 0, 1, 7, "four")]
    df = spark.createDataFrame([(k, "row", *r) for k, *r in rows], "__llm_key string, __llm_row string, start int, stop int, hash long, unit string")
    place = F.struct(F.col("__llm_key").isNull(), F.col("__llm_key"), F.col("__llm_row"), F.col("start"))
    assert sorted(tuple(r) for r in lines._later(df, place).collect()) == [("c", "row", 2, 3), ("e", "row", 1, 2)]


# --- tokens


def test_encoding_equals_the_library_and_decodes(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = odd.select("doc_id", "text", bpe.encode("text", path, odd).alias("ids")).withColumn("decoded", bpe.decode("ids", path, odd)).collect()
    assert len(out) == odd.count()
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert empty(odd).select(bpe.encode("text", path, odd)).count() == 0


def test_encoding_of_random_symbols_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, memory = Tokenizer.from_file(path), bpe.Vocabulary(path), {}
    rng = random.Random(1)
    alphabets = ["aab", "etaoinshr", "éèà中文ß", "!?.,'\"-#", "0123456789", "the ing'll 've  \n\t", "".join(map(chr, range(0x20, 0x250)))]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t, got in zip(texts, bpe.encode_text(own, memory, texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


# --- mixing


def test_mixture_reaches_targets_and_repeats_itself(odd):
    sized = odd.withColumn("size", mixing.word_count(F.col("text")))
    planned = mixing.plan_mixture(sized).collect()
    assert len(planned) == odd.count()
    by = defaultdict(list)
    for r in planned:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size and r.rank in (1, None)
        by[r.source].append(r)
    total = sum(r.size for r in planned)
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6 * total
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and rows[0].target <= 2 * rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 1
    again = mixing.plan_mixture(sized.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken, r.position) for r in planned) == Counter((r.doc_id, r.size, r.taken, r.position) for r in again)
    assert mixing.plan_mixture(empty(sized)).count() == 0


def test_arranged_rows_are_ordered_and_cut(odd):
    sized = odd.withColumn("size", mixing.word_count(F.col("text")))
    planned = mixing.plan_mixture(sized)
    rows = mixing.arrange(planned).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    taken = sum(r.taken for r in planned.collect())
    assert sum(len(WORD.findall(r.text)) for r in rows) == taken
    texts = [t for t in odd_texts() if t] + ["null key text of six words"]
    assert all(any(t.startswith(r.text) for t in texts) for r in rows)


def test_level_of_targets_equals_sharing_again_and_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, "e": 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    weight = dict(zip(sorted(sizes), (5, 2, 1, 5, 2), strict=True))
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    assert all(abs(got[s] - target[s]) < 1e-6 for s in sizes)


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_positions_invert_the_schedule(spark, slope):
    df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.position_of(F.col("u"), F.lit(slope)))
    assert all(abs(r.t + slope * (r.t**2 - r.t) - r.u) < 1e-12 for r in df.collect())


# --- sharding


def test_shards_slots_and_growth(odd):
    out = sharding.shard_documents(odd, sharding.topology(8)).collect()
    assert len(out) == odd.count()
    slots = defaultdict(list)
    for r in out:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard = defaultdict(set)
    for r in out:
        shard[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in shard.values())
    assert sharding.shard_documents(empty(odd), sharding.topology(8)).count() == 0


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    tree = sharding.topology(8)
    heavier = {**tree, "region1": {**tree["region1"], "rack3": {6: 1.0, 7: 3.0}}}
    keys = spark.range(20000)
    rows = keys.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b"), sharding.place(F.col("id"), sharding.grown(tree)).alias("c")).collect()
    counts = Counter(r.a for r in rows)
    assert all(abs(counts[s] - 2500) < 300 for s in range(8))
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b >= 4 for _, b in moved)  # only into the heavier region
    assert all(b in (6, 7) for a, b in moved if a in (4, 5))  # inside it only into the heavier rack
    assert all(r.c in (r.a, 8) for r in rows)
    assert abs(sum(r.c == 8 for r in rows) - 20000 / 9) < 300


# --- Jaccard join


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components_of(rows, hundred=75):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= hundred * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def near_copies(seed, n=150):
    """Chains of edits at the edge of the threshold, copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    docs = [" ".join(word() for _ in range(rng.randint(3, 80))) for _ in range(12)]
    while len(docs) < n:
        words = rng.choice(docs).split(" ")
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words += passage.split(" ")
        if rng.random() < 0.3:
            del words[: rng.randint(0, 4)]
        docs.append(" ".join(words))
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = jaccard.similar_documents(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of(rows)


def growing_versions(seed, chains=40):
    """Chains of versions of a text, each with four fifths of the shingles of the next: sizes differ by far inside a component."""
    rng = random.Random(seed)
    docs = []
    for _ in range(chains):
        words = [str(rng.random()) for _ in range(rng.randint(30, 60))]
        for _ in range(rng.randint(3, 6)):
            docs.append(" ".join(words))
            more = [str(rng.random()) for _ in range((len(words) - 4) // 4)]
            words = more + words if rng.random() < 0.5 else words + more
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs_of_growing_versions(spark, seed):
    rows = growing_versions(seed)
    out = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of(rows)


def test_tasks_of_equal_sets_stay_apart(spark):
    """Exact copies alone in several partitions, and the same two texts in either order, beside texts that share 40 % with them."""
    text = lambda name, k: [f"{name}{i}" for i in range(k)]
    shared, other = text("s", 60), text("p", 50)
    a, b = " ".join(shared + text("a", 44)), " ".join(shared + text("b", 44))
    c, d = " ".join(other + text("c", 30)), " ".join(text("d", 20) + other)
    parts = [[a], [a], [b], [b], [a], [c, d], [d, c], [c, d]]
    rows, by_part = [], []
    for part in parts:
        by_part.append([(len(rows) + k, x) for k, x in enumerate(part)])
        rows += by_part[-1]
    spread = spark.sparkContext.parallelize(range(len(parts)), len(parts)).flatMap(lambda k: by_part[k])
    df = spark.createDataFrame(spread, "doc_id long, text string")
    assert df.rdd.getNumPartitions() == len(parts)
    want = components_of(rows)
    assert len({i for _, _, i in want}) == 4
    out = jaccard.similar_documents(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert sorted(r.doc_id for r in jaccard.deduplicate(df).collect()) == sorted({i for _, _, i in want})


def test_join_on_odd_texts_and_keeping_one(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = jaccard.similar_documents(odd).collect()
    want = components_of(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    blank = Counter((i, t) for i, t in rows if not shingles(t))
    assert Counter((i, t) for i, t in got if not shingles(t)) == blank
    assert sorted((i is None, i or 0) for i, t in got if shingles(t)) == sorted({(c is None, c or 0) for _, n, c in want if n})
    assert jaccard.similar_documents(empty(odd)).count() == 0 and jaccard.deduplicate(empty(odd)).count() == 0


def test_components_of_a_long_path(spark):
    from tidemark.llm.components import components

    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("u"), ((F.col("id") + 1) * 7 % 61).alias("v"))
    assert {r.component for r in components(edges).collect()} == {0}


# --- language


def test_language_rejects_and_survives(odd, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, rows=200)
    out = odd.withColumn("p", langid.predict("text", model)).collect()
    assert len(out) == odd.count()
    for r in out:
        lettered = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.p.lang == "und") == (not lettered) and 0 <= r.p.score <= 1
        assert r.p.accepted <= lettered
    nothing = langid.fit(empty(docs))
    assert {r.p.lang for r in odd.select(langid.predict("text", nothing).alias("p")).collect()} == {"und"}


def test_sorted_tokens_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        tokens = np.sort(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        assert (jaccard.unpack_sorted(jaccard.pack_sorted(tokens)) == tokens).all()
    edge = np.array([0, 0, 1, (1 << 64) - 1], dtype=np.uint64)
    assert (jaccard.unpack_sorted(jaccard.pack_sorted(edge)) == edge).all()
