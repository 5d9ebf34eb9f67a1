"""Bounded samples: tiny shares, hot and missing keys, repeated rows, dirty labels."""

from pyspark.sql import functions as F

from tidemark.llm import learn


def by_label(df):
    return {r.label: r["count"] for r in df.groupBy("label").count().collect()}


def test_a_share_far_below_a_millionth_still_draws(spark):
    n = spark.range(40_000_000).filter(learn.drawn(4e-7, "id")).count()
    assert 2 <= n <= 45  # 16 expected
    assert spark.range(1000).filter(learn.drawn(1.0, "id")).count() == 1000
    assert spark.range(1000).filter(learn.drawn(0.0, "id")).count() == 0


def test_counts_of_ten_billion_rows_do_not_empty_the_sample(spark, monkeypatch):
    df = spark.range(20_000_000).select(F.col("id").alias("key"), F.lit("t").alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    monkeypatch.setattr(learn, "label_counts", lambda *_: {"0": 10**10, "1": 10**10})
    n = learn.stratified(df, "label", 20_000, "key", "text").count()
    assert 4 <= n <= 50  # 20 expected: a two-thousandth of the rows are there


def test_one_key_null_keys_and_repeated_rows(spark):
    ids = spark.range(60_000)
    one_key = ids.select(F.lit(7).alias("key"), F.col("id").cast("string").alias("text"), F.lit("a").alias("label"))
    no_key = ids.select(F.lit(None).cast("int").alias("key"), F.concat(F.lit("n"), "id").alias("text"), F.lit("b").alias("label"))
    same = ids.select(F.lit(9).alias("key"), F.lit("same").alias("text"), F.lit("c").alias("label"))
    rest = ids.select(F.col("id").cast("int").alias("key"), F.concat(F.lit("r"), "id").alias("text"), F.when(F.col("id") % 2 == 0, "d").alias("label"))
    got = by_label(learn.stratified(one_key.union(no_key).union(same).union(rest), "label", 4000, "key", "text"))
    assert set(got) == {"a", "b", "c", "d"} and got["c"] == 1
    assert all(850 <= got[x] <= 1150 for x in "abd")


def test_a_hot_key_does_not_widen_a_training_sample(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("k"), F.concat(F.lit("text "), "id").alias("t"))
    labels = docs.select("k").distinct().select("k", (F.col("k") % 2).alias("y"))
    labels = labels.union(labels).union(spark.createDataFrame([(None, 1), (6, None)], "k long, y long"))
    sample, counts = learn.training_sample(docs, labels.union(labels.filter("k = 5")), "t", "y", "k", 600)
    assert sum(counts.values()) == 20_001
    n = by_label(sample)
    assert sum(n.values()) <= 1000 and min(n.values()) > 150


def test_more_labels_than_a_sample_can_hold(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.lit("x").alias("text"), F.when(F.col("id") < 1000, "often").otherwise(F.col("id").cast("string")).alias("label"))
    counts = learn.label_counts(df, "label")
    assert len(counts) == learn.MOST_LABELS and counts["often"] == 1000
    assert learn.stratified(df, "label", 500, "key", "text").count() <= 850
    assert learn.stratified(df.limit(0), "label", 500, "key", "text").count() == 0
