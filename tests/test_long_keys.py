"""Sockets that fit a task are taken whole, longer ones are cut; both ways give the same rows."""

import random

from pyspark.sql import functions as F

from tidemark.catalog import sources as CS
from tidemark.operators import slices as SL
from tidemark.plans import timeseries as TS
from tidemark.session import materialize
from tidemark.streaming import enrich as EN
from tidemark.streaming import windows as W

SAMPLE = """sock_cookie string, ts_ns long, bytes_recv long, bytes_sent long, total_retrans long, rcv_ooopack long, srtt_us long,
 min_rtt_us long, delivery_rate_bps long, rate_app_limited boolean, snd_cwnd long, rcv_wnd long, seq long"""


def _samples(spark):
    rng, rows = random.Random(7), []
    for cookie, n in (("a", 300), ("b", 40), ("c", 3), ("d", 1)):
        recv = sent = lost = 0
        for i in range(n):
            if i % 70 == 69:
                recv = sent = lost = 0
            recv += rng.randrange(90_000 if cookie != "b" else 90)
            sent += rng.randrange(80_000 if cookie == "b" else 80)
            lost += rng.randrange(3)
            rate = rng.choice([None, rng.randrange(1_000_000)])
            rows.append((cookie, i * 300_000_000 + rng.randrange(200_000_000), recv, sent, lost, lost // 2, 1000 + rng.randrange(5000), rng.choice([None, 900]), rate, rng.random() < 0.1, rng.randrange(9), 70_000, i))
    return materialize(spark.createDataFrame(rows, SAMPLE).repartition(5), "test-samples")


def _plain(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def _judged(samples):
    seg, stats, shapes = TS.read_series(samples, ("seq",))
    rates = TS.interval_rates(seg, stats, ("seq",))
    sustained = TS.sustained_rates(rates, TS.robust_peaks(rates, ("seq",)))
    tables = [
        seg.select("sock_cookie", "seq", "seg", F.coalesce("prev_ts_ns", F.lit(-1))), rates.select("sock_cookie", "seq", "t", "rate"),
        sustained.select("sock_cookie", "seg", "n_rates", "peak", "sustained"), TS.queueing(seg, stats).select("sock_cookie", "seg", "worst_ratio", F.coalesce("onset", F.lit(-1))),
        shapes.na.fill(-1), TS.aggregate_buckets(seg, stats), TS.sampled_ceilings(seg, stats, shapes).na.fill(-1),
    ]
    return TS.known(seg), [_plain(t) for t in tables]


def test_whole_and_cut_sockets_are_judged_alike(spark, monkeypatch):
    samples = _samples(spark)
    whole, want = _judged(samples)
    assert whole and all(want)
    monkeypatch.setattr(SL, "WHOLE_ROWS", 50)  # socket a alone is cut
    mixed, got = _judged(samples)
    assert not mixed
    assert got == want


def test_only_long_keys_are_cut(spark, monkeypatch):
    samples = _samples(spark)
    assert SL.uncut(SL.with_slices(samples, "ts_ns", keys=["sock_cookie"]))
    monkeypatch.setattr(SL, "WHOLE_ROWS", 50)
    cut = SL.with_slices(samples, "ts_ns", keys=["sock_cookie"])
    slices = {r[0]: (r[1], r[2]) for r in cut.groupBy("sock_cookie").agg(F.max(SL.SLICE), F.count_distinct(SL.SLICE)).collect()}
    assert slices["a"][1] > 8
    assert {slices[c] for c in "bcd"} == {(-1, 1)}
    run = SL.prefix(cut, ["sock_cookie"], "ts_ns", {"n": ("sum", F.lit(1))}, ties=("seq",))
    assert run.where(F.col("n") != F.col("seq") + 1).count() == 0


def test_whole_sockets_take_one_shuffle(spark):
    plan = TS.segments(_samples(spark), ("seq",), store=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_capture_lines_are_stored_compressed(spark, tmp_path):
    for name, df in {
        "events": spark.sql("""SELECT id AS event_id, timestamp_millis(1700000000000 + id * 1000) AS ts, id % 9 AS user_id, 'view' AS event_type, 1.5D AS value,
          concat('{"k": ', id % 100, '}') AS props FROM range(2000)"""),
        "customer": spark.sql("SELECT id AS c_custkey, id % 3 AS c_nationkey, 12.5D AS c_acctbal, 'X' AS c_mktsegment FROM range(10)"),
        "nation": spark.sql("SELECT id AS n_nationkey, id % 2 AS n_regionkey FROM range(3)"),
        "region": spark.sql("SELECT id AS r_regionkey, 'EUROPE' AS r_name FROM range(2)"),
        "lineitem": spark.sql("""SELECT id AS l_orderkey, id AS l_partkey, id % 5 AS l_suppkey, 1 AS l_linenumber, 3.0D AS l_quantity, 10.0D AS l_extendedprice, 0.01D AS l_discount,
          0.02D AS l_tax, TIMESTAMP'1998-01-01' + make_dt_interval(id) AS l_shipdate FROM range(50)"""),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.text(CS._capture(spark, str(tmp_path)))
    assert all(f.endswith(".gz") for f in lines.inputFiles())
    assert lines.count() == 2060
    assert lines.where("length(value) > 1048576").count() == 3


def test_answers_meet_connects_in_cells_of_time(spark, tmp_path):
    """Answers at, and one past, the reach, on both sides of a cell's edge."""
    reach = 1_000_000
    sockets = [("s", t, i, kind, 1, "x" if kind == "connect" else None, None, None, None) for i, (t, kind) in enumerate([(5 * reach + 4, "connect"), (5 * reach + 9, "close")])]
    sockets = spark.createDataFrame(sockets, "sock_cookie string, ts_ns long, seq long, kind string, pid int, ip string, sni string, tls_version string, cipher int")
    regions = spark.createDataFrame([("x", "here")], "ip string, region string")
    for i, (ago, found) in enumerate([(reach, True), (reach + 1, False), (0, True), (-1, False)]):
        answers = spark.createDataFrame([("x", 5 * reach + 4 - ago, 9, "name"), ("x", 4, 8, "old")], "ip string, ts_ns long, seq long, host string")
        live = [W.folder_stream(df, f"cells-{i}") for df in (sockets, answers)]
        got = W.run_to_end(lambda ticks, live=live: EN.enriched_stream(*live, regions, ticks, resolved_within_ns=reach), spark, f"cells-{i}")
        assert [(r.host, r.resolved_ago_ns) for r in got.collect()] == [("name", ago) if found else (None, None)]
