import os

import pandas as pd
import pytest

from tidemark.functions import columns as C
from tidemark.plans import correlate as CR
from tidemark.sources import tables as T
from tidemark.streaming import correlation as SR
from tidemark.streaming import enrich as EN
from tidemark.streaming import windows as W

COLS = ["conn", "seq", "ts_ns", "verb", "req_seq", "http_status", "content_length", "ttfb_ns", "download_ns", "total_ns", "partial", "delimitation"]


@pytest.fixture()
def in_files(spark, sf_dir, tmp_path):
    """The events in six files, oldest first, so that a stream sees them in several batches."""
    e = T.read(spark, sf_dir, "events").toPandas().sort_values("ts")
    step = len(e) // 6 + 1
    for i in range(6):
        part = e.iloc[i * step : (i + 1) * step]
        part.to_parquet(tmp_path / f"{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        stamp = 1_700_000_000 + i
        os.utime(tmp_path / f"{i}.parquet", (stamp, stamp))
    schema = spark.read.parquet(str(tmp_path / "0.parquet")).schema
    return T.event_columns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path)))


def norm(rows):
    return sorted(tuple(None if pd.isna(r[c]) else r[c] for c in COLS) for r in rows)


def test_stream_equals_batch(spark, sf_dir, in_files):
    batch = CR.correlate_requests(T.wire_events(T.base_events(spark, sf_dir))).collect()
    live = W.run_once(SR.correlate_stream(T.wire_events(in_files), timeout_ms=10**13), "t-requests", end=SR.end_of_requests).collect()
    assert norm(live) == norm(batch)
    assert sum(r.flushed for r in live) == sum(r.open for r in batch) > 0


def test_open_requests_are_flushed_by_time(spark, sf_dir, in_files):
    everything = CR.correlate_requests(T.wire_events(T.base_events(spark, sf_dir))).count()
    live = W.run_once(SR.correlate_stream(T.wire_events(in_files), timeout_ms=1), "t-flush")
    assert 0 < live.where("flushed").count() <= everything


EVENT = "conn string, ts_ns long, seq long, kind string, verb string, http_status int, content_length long, bytes long, head_bytes long, head_complete boolean"


def wire(ms, seq, kind, **more):
    return ("c", 1_700_000_000_000_000_000 + ms * 1_000_000, seq, kind, more.get("verb"), more.get("status"), None, 100, 100, True)


def test_a_response_may_arrive_before_its_request(spark, tmp_path):
    """The response is in the first micro-batch, its request in the second, inside the watermark."""
    parts = [[wire(50, 2, "response", status=200), wire(300, 3, "request", verb="GET")], [wire(10, 1, "request", verb="GET"), wire(400, 4, "response", status=404)], [wire(900_000, 9, "link")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        file = next((tmp_path / f"p{i}").glob("*.parquet"))
        file.rename(tmp_path / f"{i}.parquet")
        os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(tmp_path))
    live = W.run_once(SR.correlate_stream(stream, timeout_ms=10**9), "t-swap", end=SR.end_of_requests).collect()
    want = CR.correlate_requests(spark.createDataFrame([r for p in parts for r in p], EVENT)).collect()
    assert norm(live) == norm(want)
    assert sorted((r.seq, r.http_status) for r in live) == [(1, 200), (3, 404)]


def test_live_connections_equal_batch(spark, sf_dir, in_files):
    sock = lambda e: T.socket_events(e).where("kind IN ('connect', 'close')")
    cols = ["seq", "sock_cookie", "connect_ts", "close_ts", "lifetime_ns", "pid", "partial"]
    want = CR.connect_close(sock(T.base_events(spark, sf_dir))).select(cols).collect()
    got = W.run_once(SR.connection_stream(sock(in_files)), "t-conns", end=SR.end_of_connections).select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_table_that_is_a_folder_streams(spark, sf_dir, tmp_path):
    T.read(spark, sf_dir, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = W.run_once(W.table_stream(spark, str(tmp_path), "events", files_per_batch=1), "t-folder")
    assert got.count() == T.read(spark, sf_dir, "events").count() and got.select("batch").distinct().count() == 3
    nothing = W.run_once(W.table_stream(spark, str(tmp_path), "events").where("false"), "t-nothing")
    assert nothing.count() == 0


def test_windows_settle_to_the_batch_counts(spark, sf_dir, in_files):
    got = W.latest(W.run_once(W.scorecard_windows(T.ops_from(in_files)), "t-win", "update"), ["start_us", "bucket", "s3_op"])
    want = T.ops(spark, sf_dir).selectExpr("count(http_status) AS n").first().n
    assert got.selectExpr("sum(ops) AS n").first().n == want


def in_batches(spark, folder, parts, schema):
    """A stream that sees each part in a micro-batch of its own."""
    folder.mkdir()
    for i, rows in enumerate(parts):
        part = folder.parent / f"{folder.name}-part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


S0 = 1_700_000_000_000_000_000
SEC = 10**9


def test_connections_are_enriched_live_as_in_batch(spark, tmp_path):
    """A connect and its name that come a micro-batch after the close, partners that never come, and one that is too old."""
    sock = "sock_cookie string, ts_ns long, seq long, kind string, pid long, ip string, sni string, tls_version string, cipher int"
    at = lambda s: S0 + int(s * SEC)
    s1 = [
        ("a", at(5), 1, "close", 1, None, None, None, None),
        ("b", at(1), 2, "connect", 2, "ip2", None, None, None),
        ("b", at(2), 3, "client_hello", 2, None, "name-b", None, None),
        ("c", at(3), 4, "close", 3, None, None, None, None),
        (None, at(3), 5, "close", 3, None, None, None, None),
    ]
    s2 = [
        ("a", at(2), 6, "connect", 7, "ip1", None, None, None),  # late, before its close
        ("a", at(4), 7, "server_hello", 7, None, None, "TLSv1.3", 4866),
        ("a", at(1), 8, "client_hello", 7, None, "too-early", None, None),
        ("b", at(9), 9, "close", 2, None, None, None, None),
        ("b", at(9), 10, "close", 2, None, None, None, None),  # nothing was opened since
        ("d", at(10), 11, "connect", 4, "ip3", None, None, None),
        ("e", at(11), 12, "connect", 5, "ip1", None, None, None),
    ]
    s3 = [("d", at(200), 13, "close", 4, None, None, None, None), ("e", at(30), 14, "close", 5, None, None, None, None), ("e", at(31), 15, "connect", 6, "ip9", None, None, None)]
    names = "ip string, ts_ns long, seq long, host string"
    a1 = [("ip2", at(1), 1, "host-two"), ("ip2", at(1.5), 2, "after-the-connect"), (None, at(1), 3, "x")]
    a2 = [("ip1", at(0.5), 4, "older"), ("ip1", at(1.5), 5, "host-one"), ("ip3", at(9), 6, None)]
    a3 = [("ip3", at(150), 7, "later")]
    regions = spark.createDataFrame([("ip1", "north"), ("ip3", "south")], "ip string, region string")
    sockets, answers = in_batches(spark, tmp_path / "s", [s1, s2, s3], sock), in_batches(spark, tmp_path / "a", [a1, a2, a3], names)
    bounds = {"max_life_ns": 100 * SEC, "resolved_within_ns": 5 * SEC}
    live = W.run_to_end(lambda ticks: EN.enriched_stream(sockets, answers, regions, ticks, late_by="10 seconds", **bounds), spark, "t-enriched")
    want = CR.enriched_connections(spark.createDataFrame(s1 + s2 + s3, sock), spark.createDataFrame(a1 + a2 + a3, names), regions, **bounds)
    named = lambda df: {(r.sock_cookie, r.seq): tuple(r)[2:] for r in df.drop("batch").collect()}
    got, expected = named(live), named(want)
    assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in expected.items() if k[0]}
    rows = {(r.sock_cookie, r.seq): r for r in live.collect()}
    assert (rows["a", 1].pid, rows["a", 1].host, rows["a", 1].region, rows["a", 1].tls_version, rows["a", 1].sni) == (7, "host-one", "north", "TLSv1.3", None)
    assert (rows["b", 9].host, rows["b", 9].sni, rows["b", 9].region, rows["b", 10].partial) == ("host-two", "name-b", None, True)
    assert rows["c", 4].partial and rows["d", 13].partial and rows["d", 13].ip is None
    assert (rows["e", 14].lifetime_ns, rows["e", 14].host) == (19 * SEC, None)


def test_state_is_gone_when_its_time_is_over(spark, tmp_path):
    schema = "sock_cookie string, ts_ns long, seq long, kind string, pid long"
    ms = lambda t: S0 + t * 1_000_000
    parts = [[("a", ms(0), 1, "connect", 1), ("b", ms(10), 2, "connect", 2)], [("b", ms(30_000), 3, "connect", 3), ("c", ms(40_000), 4, "connect", 4)], [("d", ms(70_000), 5, "connect", 5)]]
    stream = in_batches(spark, tmp_path / "e", parts, schema)
    log = str(tmp_path / "log")
    W.drain(SR.connection_stream(stream, late_by="1 second", timeout_ms=35_000), str(tmp_path / "out"), log)
    # the watermark stands at 69 s: a (0 s) and b's first connect are long over, c's 40 s are within 35 s of it
    assert {r.sock_cookie for r in SR.state_table(log, spark, "open").collect()} == {"c", "b"} - ({"b"} if 30_000 + 35_000 < 69_000 else set())
    assert [(r.sock_cookie, r.seq) for r in SR.state_table(log, spark, "waiting").collect()] == [("d", 5)]


def test_percentiles_of_windows_merged_from_panes_keep_their_rank(spark):
    """Far more values than a sketch holds: the rank of each answer is within the stated error, and counts are exact."""
    k, n = 512, 120_000
    ops = spark.range(n).selectExpr(
        "CAST(id AS STRING) AS op_id", "1700000000000000000 + id * 1000000000 AS ts_ns", "concat('b', id % 2) AS bucket", "'GetObject' AS s3_op", "'GET' AS verb",
        "CASE WHEN id % 50 = 0 THEN 503 ELSE 200 END AS http_status", "CAST(pmod(xxhash64(id), 1000003) + 1 AS BIGINT) AS ttfb_ns", "false AS partial", "'clean' AS delimitation",
    )
    panes = W.scorecard_panes(ops, "1 hour", k=k)
    got = {(r.start_us, r.bucket): r for r in W.merged_windows(panes, 6, {"p50": 0.5, "p95": 0.95}).collect()}
    good = ops.where(C.timeable()).selectExpr("bucket", "ts_ns div 3600000000000 AS hour", "ttfb_ns").toPandas()
    assert len(got) == 2 * (good.hour.nunique() + 5)
    for (start, bucket), r in got.items():
        hour = start // 3_600_000_000
        own = good[(good.bucket == bucket) & (good.hour >= hour) & (good.hour < hour + 6)].ttfb_ns.sort_values().to_numpy()
        assert r.latency_sample == len(own)
        for value, p in ((r.p50, 0.5), (r.p95, 0.95)):
            assert abs((own <= value).mean() - p) <= 2.3 / k**0.9 + 1 / len(own)


def test_lines_are_counted_by_the_pass_that_lands_them(spark, tmp_path):
    """Three micro-batches, one line of each outcome, and a plan with one scan."""
    from tidemark.sources import capture as CA

    good = '{"schema":"x.operation/1","op_id":"%d","ts_ns":"1","sock_cookie":"s"}'
    lines = [good % 1, "junk", '{"schema":"x.operation/9"}', good % 2, "", "junk", good % 3]
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("\n".join(lines[i * 2 :]))
    whole = CA.classify(spark.read.text(str(tmp_path)))
    want = CA.accounting(whole).first().asDict()
    rows, counts = CA.load(whole)
    assert counts == want and rows.count() == want["operations"] and want["bad_lines"] > 0
    plan = CA.operations(whole.observe("seen", *CA.counts()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "CollectMetrics" in plan
    stored, live = W.run_counted(CA.classify(CA.read_line_stream(spark, str(tmp_path), max_files=1)), "t-counted", lambda df: df.select("outcome"), CA.counts())
    assert live.first().asDict() == want and stored.count() == whole.count() and stored.select("batch").distinct().count() == 3
