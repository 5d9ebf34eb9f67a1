"""Streams that keep every core busy."""

import pytest

from tidemark.catalog import sources as CS
from tidemark.streaming import windows as W


@pytest.fixture()
def tables(spark, tmp_path):
    for name, df in {
        "events": spark.sql("""SELECT id AS event_id, timestamp_millis(1700000000000 + id * 1000) AS ts, id % 9 AS user_id, 'view' AS event_type, 1.5D AS value,
          concat('{"k": ', id % 100, '}') AS props FROM range(600)"""),
        "customer": spark.sql("SELECT id AS c_custkey, id % 3 AS c_nationkey, 12.5D AS c_acctbal, 'X' AS c_mktsegment FROM range(10)"),
        "nation": spark.sql("SELECT id AS n_nationkey, id % 2 AS n_regionkey FROM range(3)"),
        "region": spark.sql("SELECT id AS r_regionkey, 'EUROPE' AS r_name FROM range(2)"),
        "lineitem": spark.sql("""SELECT id AS l_orderkey, id AS l_partkey, id % 5 AS l_suppkey, 1 AS l_linenumber, 3.0D AS l_quantity, 10.0D AS l_extendedprice, 0.01D AS l_discount,
          0.02D AS l_tax, TIMESTAMP'1998-01-01' + make_dt_interval(id) AS l_shipdate FROM range(50)"""),
    }.items():
        df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_micro_batch_of_the_live_capture_has_files_for_all_cores(spark, tables, monkeypatch):
    """Files of 50 lines: more than two, fewer than the cores can take at once."""
    monkeypatch.setattr(CS, "LINES_A_FILE", 50)
    seen, run = [], W.run_once
    monkeypatch.setattr(W, "run_once", lambda *a: seen.append(run(*a)) or seen[-1])
    live = CS.QUERIES["src10_live_capture"](spark, tables)
    want = CS.QUERIES["src1_capture_scan"](spark, tables)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(live) == plain(want) and live.count() > 400
    assert seen[0].select("batch").distinct().count() == 1
    counts = CS.QUERIES["src2_observed_live_accounting"](spark, tables).first()
    assert counts.asDict() == CS.QUERIES["src2_src3_parse_accounting"](spark, tables).first().asDict()


def test_a_socket_waits_in_few_values(spark):
    """Thousands of samples of a socket in one micro-batch are one element of its state, and numbers beside nulls stay whole."""
    from tidemark.streaming import correlation as SR
    from tidemark.streaming import counters as CN

    big = (1 << 60) + 1
    rows = spark.range(3000).selectExpr(
        "CAST(id % 2 AS STRING) AS sock_cookie", "1700000000000000000 + id * 1000000 AS ts_ns", "id AS seq", f"{big} + id * 7 AS bytes_recv",
        "CASE WHEN id % 10 > 5 THEN id END AS bytes_sent", "id AS total_retrans",
    )
    stream = W.folder_stream(rows.coalesce(1), "t-packed")
    path, log = W.scratch_path(spark, "t-packed-out"), W.scratch_path(spark, "t-packed-log")
    W.drain(CN.gains(stream, late_by="1 hour"), path, log)
    waits = SR.state_table(log, spark, "waiting").collect()
    assert len(waits) == 2 and sum(len(r.samples) for r in waits) < 3000 * 48
    got = W.run_to_end(lambda ticks: CN.gain_windows(stream, ticks, timeout_ms=10**9), spark, "t-packed-end").collect()
    assert sum(r.samples for r in got) == 3000 and sum(r.segments_begun for r in got) == 2
    sent = [(i, i - 2) for i in range(2, 3000) if i % 10 > 5 and (i - 2) % 10 > 5]
    assert (sum(r.received for r in got), sum(r.sent for r in got), sum(r.retrans for r in got)) == (14 * 2998, 2 * len(sent), 2 * 2998)


def test_a_connect_meets_spans_and_not_every_answer(spark):
    """Three thousand answers of one address within the reach: the join's state holds their spans."""
    from tidemark.streaming import enrich as EN

    s0 = 1_700_000_000_000_000_000
    sockets = spark.createDataFrame(
        [("s", s0 + 2999 * 10**6, 1, "connect", 1, "x", None, None, None), ("s", s0 + 3001 * 10**6, 2, "close", 1, None, None, None, None), ("t", s0 + 9000 * 10**9, 3, "close", 1, None, None, None, None)],
        "sock_cookie string, ts_ns long, seq long, kind string, pid int, ip string, sni string, tls_version string, cipher int",
    )
    answers = spark.sql(f"SELECT 'x' AS ip, {s0} + id * 1000000 AS ts_ns, id AS seq, concat('n', id) AS host FROM range(3000) UNION ALL SELECT 'y', {s0} + 9000000000000, 9, 'n'")
    regions = spark.createDataFrame([("x", "here")], "ip string, region string")
    live = EN.enriched_stream(W.folder_stream(sockets, "t-spans-s"), W.folder_stream(answers, "t-spans-a"), regions)
    q = live.writeStream.format("memory").queryName("t_spans").outputMode("append").option("checkpointLocation", W.scratch_path(spark, "t-spans")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert held and max(held) < 200
