"""Trained operators on held-out rows, and on odd and missing training data."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, toxicity
from tidemark.llm import queries as q
from tidemark.llm.learn import fold

SF = "/root/testdata/sf0.01"


def labelled(spark, frame, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    return frame.join(labels, "doc_id").toPandas()


def test_quality_on_held_out_rows(spark):
    scored = q.op1_quality(spark, SF)
    assert scored.count() == 1000
    got = labelled(spark, scored, "quality")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_language_on_held_out_rows(spark):
    found = q.op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == 1000 and (held.lang_pred == held.lang).mean() >= 0.98
    assert found.accepted.mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    got = labelled(spark, q.op8_toxicity(spark, SF), "toxic")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert got[got.toxic == 0].predicted.mean() <= 0.02


def test_folds(spark):
    rows = spark.createDataFrame([(None,), (5,)], "k long").select(fold(F.col("k"), 5).alias("f")).collect()
    assert all(0 <= r.f < 5 for r in rows)


ODD = [None, "", " \n ", "x", "!!!", "A B C", "词 语", "word " * 30000, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 1.0) for i, t in enumerate(ODD)], "doc_id long, text string, score string, label double")


@pytest.mark.parametrize("label", ["none", "one class", "both"])
def test_odd_rows_and_few_labels(spark, odd, label):
    rows = {"none": [], "one class": [(0, 1), (3, 1), (None, 1), (4, None)], "both": [(i, i % 2) for i in range(10)] + [(1, 1), (77, 0)]}[label]
    labels = spark.createDataFrame(rows, "doc_id long, y int")
    models = quality.fit(odd, labels, label="y"), toxicity.fit(odd, labels, label="y")
    out = odd.withColumn("q", quality.score("text", models[0])).withColumn("t", toxicity.judge("text", models[1])).orderBy("doc_id").collect()
    assert len(out) == len(ODD)
    for r in out:
        assert 0 <= r.q <= 1 and 0 <= r.t.score <= 1
    assert out[8].q == out[9].q and out[8].t == out[9].t
    none = odd.limit(0)
    assert none.select(quality.score("text", models[0]), toxicity.judge("text", models[1]), langid.predict("text", langid.fit(none.withColumn("lang", F.lit("en"))))).count() == 0
    empty = quality.fit(none, labels, label="y")
    assert 0 <= float(empty.offset + 1e9) and np.isfinite(empty.bias)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    terms = {t: 4.0 for t in ("idiot", "moron", "disgusting", "scum", "worthless", "morons", "lowei*", "idle")}
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(9)
    words = ["idi0t", "idiott", "diot", "scam", "scum", "loweihaft", "lowei", "lowe", "disgustin", "digsusting", "wortless", "", "idl", "moronss"]
    for t in terms:
        for _ in range(300):
            w = list(t.removesuffix("*"))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "i", "s"])
            words.append("".join(w))
    for w in words:
        near = [(distance(w, t), t) for t in terms if not t.endswith("*")]
        near = [(d, t) for d, t in near if d <= toxicity.allowed_edits(t)]
        got = automaton.match(w)
        if near and (min(near)[0] == 0 or not w.startswith("lowei")):
            assert got is not None and got[1] == min(near)[0], w
        elif w.startswith("lowei"):
            assert got == ("lowei*", 0), w
        else:
            assert got is None, w


def test_misspellings_and_quotations():
    model = toxicity.ToxicityModel({"idiot": 6.0, "disgusting": 6.0})
    judged = lambda t: (lambda w: model.score(model.hits(w), len(w)))(toxicity.words_of(t))
    clean, plain = judged("what a fine day it is"), judged("what an idiot you are")
    assert clean < 0.3 < plain
    assert clean < judged("what an idi0t you are") <= plain
    assert judged("you disgustng idiot") > judged("you idiot there")
    assert judged('he said "idiot" to them') < plain
    hits = model.hits(toxicity.words_of("they wrote « idiot » on it"))
    assert [h["quoted"] for h in hits] == [True] and hits[0]["position"] == 3


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    scale = rng.normal(size=30)
    y = np.array([1.0 if scale[f].sum() + rng.normal() * 0.3 > 0 else -1.0 for f in rows])
    cost = np.full(200, 0.5)
    w, b = quality.dual_coordinate_descent(rows, scale, y, cost, epochs=400)
    x = np.zeros((200, 31))
    for i, f in enumerate(rows):
        x[i, f] = scale[f]
    x[:, 30] = 1

    def gradient(v):
        slack = np.maximum(0, 1 - y * (x @ v))
        return v - 2 * x.T @ (cost * slack * y)

    assert np.abs(gradient(np.append(w, b))).max() < 0.05


def test_language_features_take_two_bytes_a_bucket():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)) for n in (1500, 4000)] + ["word " * 70_000, "the", "", "é" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], ["label", "text"])
    (got,) = langid._counted(iter([batch]))
    sizes, gaps, counts = (got.column(c).to_pylist() for c in ("n", "gaps", "counts"))
    for text, n, g, c in zip(texts, sizes, gaps, counts, strict=True):
        data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
        found = np.bincount(np.concatenate(list(langid._subwords(data))), minlength=langid.BUCKETS + 1)[: langid.BUCKETS]
        assert np.array_equal(np.cumsum(langid._unpacked(g, n), dtype=np.uint16), np.flatnonzero(found))
        assert np.array_equal(langid._unpacked(c, n), found[found > 0])
    assert all(len(g) + len(c) == 2 * n for n, g, c in list(zip(sizes, gaps, counts, strict=True))[:2])
