"""Both sides of thresholds, unjudged paths and invariances, on small hand-made captures."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import columns as C
from tidemark.functions import http as H
from tidemark.plans import advise as A
from tidemark.plans import compare as CP
from tidemark.plans import findings as FD
from tidemark.plans import floors as FL
from tidemark.plans import health as HE
from tidemark.plans import scorecard as SC
from tidemark.sources import capture as CA
from tidemark.sources import sinks as SK
from tidemark.sources import tables as T

OPS = (
    "op_id string, ts_ns long, sock_cookie string, pid long, verb string, s3_op string, bucket string, key_hash string, http_status int, "
    "ttfb_ns long, download_ns long, total_ns long, content_length long, tcp_connect_ns long, tls_handshake_ns long, dns_latency_ns long, "
    "dns_cache_hit boolean, aws_request_id string, connection_reused boolean, partial boolean, delimitation string"
)
NAMES = [c.split(" ")[0] for c in OPS.split(", ")]
BASE = dict(
    sock_cookie="1", pid=1, verb="GET", s3_op="GetObject", bucket="b", key_hash="k", http_status=200, ttfb_ns=10_000_000, download_ns=1_000_000,
    total_ns=11_000_000, content_length=1000, connection_reused=True, partial=False, delimitation="clean",
)
CONNS = (
    "sock_cookie string, pid long, region string, endpoint_ip string, cross_region boolean, via_vpce boolean, ts_ns long, srtt_us long, "
    "min_rtt_us long, bytes_sent long, bytes_recv long, retransmits long"
)
SAMPLES = "sock_cookie string, ts_ns long, srtt_us long, min_rtt_us long"


def ops(spark, rows):
    full = [{**dict.fromkeys(NAMES), **BASE, "op_id": f"{i:05d}", "ts_ns": i * 1000, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], OPS)


def conns(spark, rows):
    return spark.createDataFrame(rows, CONNS)


def test_status_classes_and_tiers(spark):
    codes = {429: "throttle", 503: "throttle", 403: "forbidden", 404: "not_found", 400: "bad_request", 418: "client", 500: "server", 304: "success", None: None}
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    assert {r.c: r.k for r in df.select("c", C.status_class(F.col("c")).alias("k")).collect()} == codes
    names = {"DeleteObject": "free", "AbortMultipartUpload": "free", "ListObjectsV2": "tier-1", "CompleteMultipartUpload": "tier-1", "GetObject": "tier-2", "HeadObject": "tier-2"}
    df = spark.createDataFrame([(c,) for c in names], "c string")
    assert {r.c: r.k for r in df.select("c", C.price_tier(F.col("c")).alias("k")).collect()} == names


def test_hosts_and_secrets(spark):
    hosts = {
        "b.s3.eu-west-1.amazonaws.com": "eu-west-1", "s3.dualstack.us-west-2.amazonaws.com": "us-west-2", "b.s3-ap-south-1.amazonaws.com": "ap-south-1",
        "b.s3.amazonaws.com": "us-east-1", "s3.us-gov-west-1.amazonaws.com.": "us-gov-west-1", "example.com": None, "s3.eu-west-1.example.com": None,
    }
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.x for r in df.select("h", H.region_from_host(F.col("h")).alias("x")).collect()} == hosts
    lines = {
        "GET /secret/key?versionId=7&X-Amz-Signature=abc HTTP/1.1": "GET /<key>?versionId=7&X-Amz-Signature=REDACTED HTTP/1.1",
        "PUT /a": "PUT /<key>", "note X-Amz-Credential=me&y=1 tail": "note X-Amz-Credential=REDACTED&y=1 tail", "get /x?token=1": "get /x?token=1",
    }
    df = spark.createDataFrame([(h,) for h in lines], "h string")
    assert {r.h: r.x for r in df.select("h", H.redact_request_line(F.col("h")).alias("x")).collect()} == lines


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for salt in (b"", b"salt", bytes(range(80))):
        got = spark.createDataFrame([("kéy",)], "k string").select(H.keyed_hash(salt, F.col("k"))).first()[0]
        assert got == "sha256:" + hmac.new(salt, "kéy".encode(), hashlib.sha256).hexdigest()


def test_tail_needs_its_samples_and_reads_its_floor(spark):
    c = conns(spark, [("1", 1, None, None, False, False, 1, 10_000, 9_000, 0, 0, 0)])
    s = spark.createDataFrame([], SAMPLES)
    for n, ttfb, want in ((19, 10, None), (20, 10, "healthy"), (20, 90, "warn")):
        o = ops(spark, [{"ttfb_ns": ttfb * 1_000_000}] * n)
        f = FL.with_floors(o, c, FL.pooled_floor(c, s))
        rows = {r.finding_id: r for r in HE.rows(HE.with_capture(HE.op_facts(f), o, c, s), [HE.tail_rows]).collect()}
        got = rows.get("ttfb_reused_p95")
        assert (got and got.severity) == want


def test_mixed_paths_withhold_the_pooled_floor(spark):
    far = ("2", 1, "r2", None, False, False, 1, 200_000, None, 0, 0, 0)
    near = ("1", 1, "r1", None, False, False, 1, 1_000, None, 0, 0, 0)
    o = ops(spark, [{"sock_cookie": "9"}, {"sock_cookie": "1"}])
    s = spark.createDataFrame([], SAMPLES)
    for rows, want in (([near, far], [None, 1000.0]), ([near], [1000.0, 1000.0])):
        c = conns(spark, rows)
        got = [r.floor_us for r in FL.with_floors(o, c, FL.pooled_floor(c, s)).orderBy("op_id").collect()]
        assert got == want
    # a cookie two connections carry identifies neither
    c = conns(spark, [near, near])
    assert [r.floor_us for r in FL.with_floors(o, c, FL.pooled_floor(c, s)).orderBy("op_id").collect()] == [1000.0, 1000.0]


@pytest.mark.parametrize("status,verdict,code", [(200, "HEALTHY", 0), (500, "ATTENTION", 1), (None, "NO RESPONSES", 2)])
def test_overall_verdict(spark, status, verdict, code):
    c = conns(spark, [("1", 1, None, None, False, False, 1, 10_000, 9_000, 0, 0, 0)]).withColumns(
        {n: F.lit(None).cast("bigint") for n in ("rttvar_us", "snd_cwnd", "mss", "delivery_rate_bps", "lifetime_ns", "window_clamp", "busy_jiffies",
                                                "rwnd_limited_jiffies", "sndbuf_limited_jiffies", "reordering", "ca_state", "rcv_ooopack", "dsack_dups",
                                                "tls_handshake_ns", "tls_cipher")}
    ).withColumn("tls_version", F.lit(None).cast("string")).withColumn("app_limited", F.lit(None).cast("boolean"))
    o = ops(spark, [{"http_status": status}] * 6)
    rep = HE.report(o, c, spark.createDataFrame([], SAMPLES))
    got = HE.run_verdict(rep, o, c).first()
    assert (got.verdict, got.exit_code) == (verdict, code)


def test_scorecard_floors_and_unjudged(spark):
    o = ops(spark, [{"http_status": 503 if i < 5 else 200} for i in range(50)])
    assert [r.finding_id for r in SC.reliability_findings(o).collect()] == ["scorecard-throttle"]
    assert SC.reliability_findings(ops(spark, [{"http_status": 503 if i < 4 else 200} for i in range(50)])).count() == 0
    silent = ops(spark, [{"http_status": None}] * 3)
    assert SC.scorecard(silent).count() == 0
    assert SC.unjudged_run(silent, SC.capture_window(silent)).first().excluded == 3


def test_partial_stays_in_the_denominator(spark):
    fresh = {"connection_reused": False, "tcp_connect_ns": 50_000_000}
    rows = [fresh] * 51 + [{"connection_reused": True}] * 20 + [{"connection_reused": True, "partial": True}] * 40
    assert A.connection_churn(ops(spark, rows)).count() == 0
    got = A.connection_churn(ops(spark, rows[:71])).first()
    assert got.metric == "wasted_connect_ms" and got.value_num == 50 * 50.0


def test_refetch_runs_end_at_a_write_by_anyone(spark):
    get = lambda t: {"ts_ns": t}
    put = {"ts_ns": 25, "s3_op": "PutObject", "pid": 9, "partial": True}
    runs = sorted(r.reads for r in A.read_runs(ops(spark, [get(10), get(20), put, get(25), get(30)])).collect())
    assert runs == [1, 3]  # a write at the same instant does not reset the read


def test_head_fan_out_is_exempt(spark):
    head = lambda t: {"ts_ns": t, "s3_op": "HeadObject"}
    get = lambda t: {"ts_ns": t}
    s = 1_000_000_000
    got = sorted((r.head_ts, r.reads) for r in A.head_claims(ops(spark, [head(0), get(1), head(5 * s), get(6 * s), get(6 * s), head(9 * s), get(10 * s + 1)])).collect())
    assert got == [(0, 1), (5 * s, 2)]


def test_recovery_window_and_capture_end(spark):
    s = 1_000_000_000
    rows = [{"ts_ns": 0, "http_status": 503}, {"ts_ns": 30 * s}, {"ts_ns": 40 * s, "http_status": 503}, {"ts_ns": 71 * s}, {"ts_ns": 80 * s, "http_status": 503}]
    got = {r.ts_ns // s: r.recovered for r in A.throttle_recovery(ops(spark, rows)).collect()}
    assert got == {0: True, 40: False, 80: None}


def test_concurrency_counts_sockets_not_requests(spark):
    iv = [("1", 0, 100), ("1", 50, 100), ("2", 140, 20), ("3", 160, 10)]
    df = spark.createDataFrame([(1, c, t, n) for c, t, n in iv], "pid long, sock_cookie string, ts_ns long, total_ns long")
    r = A.concurrency(df).first()
    assert (r.busy_ns, r.overlap_ns) == (170, 10)


def test_diff_kinds(spark):
    def run(*rows):
        df = spark.createDataFrame(list(rows), "finding_id string, s3_op string, severity string, unit string, metric string, judged long, ratio_to_rtt double, value_num double")
        return df

    base = run(("a", None, "healthy", "ms", "a", 9, None, 10.0), ("b", None, "warn", "ms", "b", 9, None, 10.0), ("reuse_rate", None, "warn", "ratio", "reuse_rate", 9, None, 0.5),
               ("tcp_connect", None, "warn", "ms", "t", 9, 4.0, 1.0))
    cur = run(("a", None, "warn", "ms", "a", 9, None, 20.0), ("c", None, "warn", "ms", "c", 9, None, 1.0), ("reuse_rate", None, "healthy", "ratio", "reuse_rate", 9, None, 0.9))
    pop = spark.createDataFrame([("*", "", 9)], "finding_id string, s3_op string, population long")
    got = {r.finding_id: r.kind for r in CP.diff(cur, base, pop).collect()}
    assert got == {"a": "regressed", "b": "resolved", "c": "new_issue", "reuse_rate": "improved", "tcp_connect": "unjudgeable"}


def test_capture_lines(spark):
    ok = '{"schema":"x.sample/1","ts_ns":"5","sock_cookie":"18446744073709551615","bytes_sent":1,"bytes_recv":1,"snd_cwnd":1,"rcv_wnd":1,"total_retrans":0,"rcv_ooopack":0,"rate_app_limited":false,"new":1}'
    lines = [ok, ok.replace('"ts_ns":"5"', '"ts_ns":5'), ok.replace("18446744073709551615", "18446744073709551616"), ok[:-1], "7", '"s"', '{"schema":"x.sample/2"}', "{}", " ", ok + " " * (1 << 20)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    c = CA.classify(df, "x", max_line_bytes=1 << 20)
    n = CA.accounting(c).first()
    assert (n.samples, n.bad_lines, n.unknown_schema) == (1, 6, 2)
    anything = CA.accounting(CA.classify(df, "x")).first()  # without a limit the long line is a record
    assert (anything.samples, anything.bad_lines, anything.unknown_schema) == (2, 5, 2)
    nested = ok[:-1] + ',"future":{"ts_ns":7,"sock_cookie":[1]}}'
    assert CA.accounting(CA.classify(spark.createDataFrame([(nested,)], "value string"), "x")).first().samples == 1
    assert CA.samples(c).first().ts_ns == 5
    with pytest.raises(CA.NoRecords, match="unknown tag"):
        CA.require_records(c.where("outcome <> 'sample'"))
    with pytest.raises(CA.NoRecords, match="empty"):
        CA.require_records(c.where("false"))


def test_sink_refuses_broken_numbers(spark, tmp_path):
    good = FD.emit(spark.range(1), finding_id="x", value_num=1.0)
    SK.write_findings(good, str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok")).first().finding_id == "x"
    with pytest.raises(Exception, match="not finite"):
        SK.write_findings(FD.emit(spark.range(1), finding_id="x", value_num=float("nan")), str(tmp_path / "bad"))


def test_findings_do_not_depend_on_partitioning(spark, sf_dir):
    cfg = replace(DEFAULT, sc_min_errors=2)
    o = T.ops(spark, sf_dir)
    a = FD.flatten(SC.reliability_findings(o, cfg), with_evidence=True).collect()
    b = FD.flatten(SC.reliability_findings(o.orderBy(F.rand(3)).repartition(13), cfg), with_evidence=True).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
