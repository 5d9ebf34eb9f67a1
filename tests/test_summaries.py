"""Mergeable summaries, counter segments and late rows of streams, over several micro-batches."""

import os

from pyspark.sql import functions as F

from tidemark.plans import scorecard as SC
from tidemark.plans import study as ST
from tidemark.plans import timeseries as TS
from tidemark.sources import tables as T
from tidemark.streaming import counters as CN
from tidemark.streaming import summaries as SU
from tidemark.streaming import windows as W

S0 = 1_700_000_000_000_000_000
SEC = 10**9


def in_batches(spark, folder, parts, schema):
    """Each list of rows is one micro-batch of the stream."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
        next((folder / f"p{i}").glob("*.parquet")).rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(folder))


def event_files(spark, sf_dir, name):
    return T.event_columns(W.arrival_stream(T.read(spark, sf_dir, "events").withColumn("turn", (F.col("event_id") % 3).cast("int")), "turn", name))


def test_merged_scorecard_equals_the_batch_one_and_reads_no_record(spark, sf_dir):
    ops = T.ops_from(event_files(spark, sf_dir, "t-score"))
    parts = SU.collect_parts(ops, "t-parts", SU.scorecard_parts)
    assert parts.select("batch").distinct().count() == 3
    got = SU.merged_scorecard(parts)
    want = SC.scorecard(T.ops(spark, sf_dir))
    plain = lambda df: {(r.bucket, r.s3_op): tuple(str(v) for v in r) for r in df.select(*want.columns).collect()}
    assert plain(got) == plain(want)
    assert all("parts-" in f for f in got.inputFiles())


def test_a_repeated_micro_batch_counts_once(spark, sf_dir):
    """The parts of a batch that is run again replace its own."""
    ops = T.ops(spark, sf_dir)
    half = ops.where("CAST(op_id AS BIGINT) % 2 = 0")
    path = W.scratch_path(spark, "t-again")
    for batch, df in ((0, half), (1, ops.subtract(half)), (1, ops.subtract(half))):
        SU.scorecard_parts(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    got = SU.merged_scorecard(spark.read.parquet(path))
    assert sum(r.group_total for r in got.collect()) == sum(r.group_total for r in SC.scorecard(ops).collect())


def test_merged_percentiles_keep_their_rank_beyond_the_sketch(spark):
    ops = spark.range(60_000).selectExpr(
        "id % 4 AS part", "'b' AS bucket", "'GetObject' AS s3_op", "200 AS http_status", "id AS ts_ns", "CAST(pmod(xxhash64(id), 1000003) + 1 AS BIGINT) AS ttfb_ns",
        "CAST(1000 AS BIGINT) AS content_length", "id + 1 AS download_ns", "false AS partial", "'clean' AS delimitation",
    )
    parts = [SU.scorecard_parts(ops.where(F.col("part") == i), k=512) for i in range(4)]
    r = SU.merged_scorecard(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])).first()
    values = sorted(x.ttfb_ns for x in ops.select("ttfb_ns").collect())
    for value, p in ((r.ttfb_p50_ns, 0.5), (r.ttfb_p95_ns, 0.95), (r.ttfb_p99_ns, 0.99)):
        assert abs(sum(v <= value for v in values) / len(values) - p) <= 2.3 / 512**0.9


def test_late_rows_and_rows_on_time_add_up(spark, tmp_path):
    """Three micro-batches: a watermark of ten seconds passes one row of the second and two of the third; a row without a time is on time."""
    schema = "ts_ns long, id long"
    at = lambda s: S0 + s * SEC
    parts = [[(at(100), 1), (at(5), 2)], [(at(89), 3), (at(90), 4), (at(300), 5), (None, 6)], [(at(289), 7), (at(291), 8), (at(1), 9)]]
    on_time, late = W.split_late(in_batches(spark, tmp_path, parts, schema), "t-late", 10 * SEC)
    assert sorted(r.id for r in late.collect()) == [3, 7, 9]
    assert sorted(r.id for r in on_time.collect()) == [1, 2, 4, 5, 6, 8]
    assert late.schema == on_time.schema and {(r.id, r.batch) for r in late.collect()} == {(3, 1), (7, 2), (9, 2)}


def test_no_rows_give_no_late_rows(spark, tmp_path):
    stream = W.folder_stream(spark.createDataFrame([], "ts_ns long, id long"), "t-none")
    on_time, late = W.split_late(stream, "t-none-late", SEC)
    assert on_time.count() == late.count() == 0


COUNTERS = "sock_cookie string, ts_ns long, seq long, bytes_recv long, bytes_sent long, total_retrans long"


def test_counter_windows_equal_batch_segments(spark, tmp_path):
    """Samples out of order over three micro-batches, a counter that falls, equal times, and a socket without a name."""
    at = lambda s: S0 + int(s * SEC)
    parts = [
        [("a", at(1), 1, 100, 10, 0), ("a", at(3), 3, 400, 30, 1), (None, at(1), 1, 5, 5, 0)],
        [("a", at(2), 2, 250, 20, 1), ("b", at(9), 4, 70, 1, 0), ("a", at(12), 5, 20, 2, 0), ("a", at(12), 6, 50, 2, 3)],
        [("a", at(30), 8, 90, 9, 4), ("b", at(31), 9, 80, 1, 0), (None, at(31), 10, 9, 5, 0), ("a", at(30.5), 11, 95, 8, 4)],
    ]
    stream = in_batches(spark, tmp_path, parts, COUNTERS)
    got = W.run_to_end(lambda ticks: CN.gain_windows(stream, ticks, late_by="20 seconds", timeout_ms=10**9), spark, "t-gains").drop("batch")
    rows = spark.createDataFrame([r for p in parts for r in p], COUNTERS).withColumn("rcv_ooopack", F.lit(0).cast("long"))
    seg = TS.segments(rows, ("seq",))
    gain = lambda c: F.coalesce(F.sum(F.col(c) - F.col(f"prev_{c}")), F.lit(0))
    want = seg.groupBy(F.expr("(ts_ns div 1000000000) * 1000000").alias("start_us")).agg(
        F.count(F.lit(1)), F.count_if(F.col("prev_ts_ns").isNull()), gain("bytes_recv"), gain("bytes_sent"), gain("total_retrans")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sockets_return_as_counted(spark):
    """More sockets than a sketch holds: estimates within three standard deviations of the exact counts."""
    seen = spark.range(60_000).selectExpr("CAST(id % 4 AS BIGINT) * 86400000000000 AS ts_ns", "CAST((id * 7 + (id % 4) * 5000) % 20000 AS STRING) AS sock_cookie")
    got = {r.start_us // 86_400_000_000: r for r in SU.socket_movement(SU.socket_panes(seen), 2).collect()}
    days = {d: {r.sock_cookie for r in seen.where(f"ts_ns div 86400000000000 = {d}").collect()} for d in range(4)}
    for d, own in days.items():
        before = days.get(d - 1, set()) | days.get(d - 2, set())
        r, room = got[d], 3 * len(own | before) / 4096**0.5
        assert r.records == 15_000
        for value, exact in ((r.sockets, own), (r.returned, own & before), (r.fresh, own - before), (r.sockets_in_memory, own | before)):
            assert abs(value - len(exact)) <= room


def test_no_hot_object_is_missed(spark):
    """100,000 objects read once each and eight read often, in three parts: far more objects than are tracked."""
    share = 0.01
    cold = spark.range(100_000).selectExpr("'x' AS app", "'get' AS op", "concat('o', id) AS object_id", "id % 3 AS part")
    hot = spark.range(8 * 2_000).selectExpr("'x' AS app", "'get' AS op", "concat('hot', id % 8) AS object_id", "id % 3 AS part")
    trace = cold.unionByName(hot)
    parts = [SU.object_parts(trace.where(F.col("part") == i), share) for i in range(3)]
    got = {r.object_id: r for r in SU.hot_objects(parts[0].unionByName(parts[1]).unionByName(parts[2]), share).collect()}
    assert got.keys() == {f"hot{i}" for i in range(8)} and {r.total for r in got.values()} == {116_000}
    assert all(abs(r.n - 2_000) <= 0.22 * share * 116_000 for r in got.values())


def test_pooled_counts_shuffle_the_accesses_once(spark, sf_dir):
    trace = T.trace(spark, sf_dir)
    key = lambda df: sorted(map(str, df.collect()))
    both = ST.summary(trace, pool=True)
    assert key(both) == key(ST.summary(ST.split_and_pooled(trace)))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
