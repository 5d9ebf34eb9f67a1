from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.config import DEFAULT
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.plans import geo as G
from tidemark.plans import scorecard as SC
from tidemark.session import scratch_path
from tidemark.sources import access as AC
from tidemark.sources import capture as CA
from tidemark.sources import sinks as SK
from tidemark.sources import tables as T
from tidemark.streaming import windows as W

NS = "capture"
# Fixed value: the capture format's line limit.
LINE_LIMIT = 1 << 20
# A compressed file is read by one task.
LINES_A_FILE = 1_000_000


def _op_json(numeric_ts=False):
    ts = F.col("ts_ns") if numeric_ts else F.col("ts_ns").cast("string")
    return F.to_json(
        F.struct(
            F.lit(f"{NS}.operation/1").alias("schema"), "op_id", ts.alias("ts_ns"), "sock_cookie", F.lit(0).alias("req_seq"),
            F.struct("pid").alias("app"), "verb", "s3_op", "bucket", "key_hash", "ttfb_ns", "download_ns", "total_ns", "content_length",
            F.lit(0).alias("bytes_sent"), F.lit(0).alias("bytes_recv"), F.lit(0).alias("retransmits"), "connection_reused", "http_status",
            "partial", "delimitation", F.lit("ignored").alias("a_future_field"), F.struct(F.lit(7).alias("ts_ns"), F.array(F.lit(1)).alias("x")).alias("future"),
        )
    )


def _capture(s, d):
    """The tables as a capture: requests and connections as lines, some of them damaged."""
    o = T.ops(s, d).withColumn("i", F.col("op_id").cast("bigint"))
    good = _op_json()
    ops = o.select(
        F.when(F.col("i") % 97 == 0, _op_json(True))
        .when(F.col("i") % 89 == 0, F.regexp_replace(good, "operation/1", "operation/9"))
        .when(F.col("i") % 83 == 0, F.substring(good, F.lit(1), F.length(good) - 5))
        .when(F.col("i") % 79 == 0, F.lit("  "))
        .when(F.col("i") % 73 == 0, F.lit("[1,2]"))
        .when(F.col("i") % 71 == 0, F.regexp_replace(good, '"op_id":"[0-9]+",', ""))
        .when(F.col("i") % 997 == 5, F.concat(good, F.repeat(F.lit(" "), 1 << 20)))
        .otherwise(good)
        .alias("value")
    )
    c = T.conns(s, d).select(
        F.to_json(
            F.struct(
                F.lit(f"{NS}.connection/2").alias("schema"), F.col("ts_ns").cast("string").alias("ts_ns"), "sock_cookie", F.struct("pid").alias("app"),
                F.struct("region", "endpoint_ip", "via_vpce", "cross_region").alias("endpoint"), F.lit(False).alias("connect_failed"),
                F.struct(F.lit(True).alias("seen"), "sni").alias("tls"), "bytes_sent", "bytes_recv", "retransmits", "srtt_us", "min_rtt_us",
                F.lit(False).alias("partial"),
            )
        ).alias("value")
    )
    x = T.samples(s, d).select(
        F.to_json(
            F.struct(
                F.lit(f"{NS}.sample/1").alias("schema"), F.col("ts_ns").cast("string").alias("ts_ns"), "sock_cookie", "bytes_sent", "bytes_recv",
                F.lit(10).alias("snd_cwnd"), F.lit(0).alias("rcv_wnd"), "total_retrans", "rcv_ooopack", "rate_app_limited",
            )
        ).alias("value")
    )
    path = scratch_path(s, "capture")
    # lines repeat their field names and some are padded to a megabyte: compressed they are a small part of that
    ops.unionByName(c).unionByName(x).write.option("maxRecordsPerFile", LINES_A_FILE).text(path, compression="gzip")
    return path


def _live_operations(s, d):
    """The same capture as a stream of lines, landed and read as a table."""
    lines = CA.read_line_stream(s, _capture(s, d))
    return W.run_once(CA.operations(CA.classify(lines, NS, LINE_LIMIT)), "live-capture").drop("batch")


def _classified(s, d):
    return CA.classify(CA.read_lines(s, _capture(s, d)), NS, LINE_LIMIT)


def _access_lines(s, d):
    o = T.ops(s, d).withColumn("i", F.col("op_id").cast("bigint"))
    norm = F.to_json(
        F.struct(
            "ts_ns", F.when(F.col("verb") == "GET", "get").when(F.col("verb") == "HEAD", "head").otherwise("put").alias("op"),
            F.concat(F.coalesce("bucket", F.lit("none")), F.lit("/"), "key_hash").alias("object_id"),
            F.when(F.col("i") % 2 == 0, F.array(F.lit(0).cast("bigint"), F.col("total_ns"))).alias("range"), F.col("content_length").alias("size"),
        )
    )
    text = F.concat_ws(
        " ", F.expr("CAST(ts_ns div 1000000 AS STRING)"),
        F.when(F.col("i") % 5 == 0, F.lit("REST.GET.BUCKET")).otherwise(F.concat(F.lit("REST."), "verb", F.lit(".OBJECT"))),
        F.concat(F.lit("x/"), "key_hash"), F.when(F.col("i") % 4 != 0, F.col("content_length").cast("string")),
        F.when((F.col("i") % 4 != 0) & (F.col("i") % 7 == 0) & F.col("content_length").isNotNull(), F.lit("10 99")),
    )
    junk = F.when(F.col("i") % 10 == 2, '{"schema": 7}').when(F.col("i") % 10 == 3, f'{{"schema":"{NS}.sample/1"}}').otherwise("no trace line")
    return o.select(F.when(F.col("i") % 4 == 0, _op_json()).when(F.col("i") % 4 == 1, norm).when(F.col("i") % 4 == 2, text).otherwise(junk).alias("value"))


def _access(s, d):
    return AC.classify_access(_access_lines(s, d), NS)


def _sunk(s, d, what):
    path = scratch_path(s, "sink")
    o = T.ops(s, d)
    cfg = replace(DEFAULT, sc_min_errors=3)
    advice = {fid: f"advice/{fid}" for fid, _ in SC.ERROR_FINDINGS.values()}
    SK.write_scorecard(SC.scorecard(o, cfg), SC.reliability_findings(o, cfg), path, emitted_at="2024-06-01T00:00:00Z", recommendations=advice)
    return s.read.json(f"{path}/{what}")


GEO = replace(DEFAULT, triage_min_ms=0.5, cluster_min_ms=1.0)


def _bucket_ms(s, d):
    j = T.ops(s, d).join(T.conns(s, d).select("sock_cookie", "srtt_us"), "sock_cookie").where(F.col("bucket").isNotNull() & (F.col("srtt_us") > 0))
    return exact_quantiles(j, ["bucket"], {"r": F.col("srtt_us") / 1e3}, [Stat("bucket_ms", "r", "mid")]).select("bucket", "bucket_ms")


QUERIES = {
    "src1_capture_scan": lambda s, d: CA.operations(_classified(s, d)).select("op_id", "ts_ns", "sock_cookie", "pid", "s3_op", "bucket", "http_status", "ttfb_ns", "partial"),
    "src10_live_capture": lambda s, d: _live_operations(s, d).select("op_id", "ts_ns", "sock_cookie", "pid", "s3_op", "bucket", "http_status", "ttfb_ns", "partial"),
    "src1_samples": lambda s, d: CA.samples(_classified(s, d)).select("sock_cookie", "ts_ns", "bytes_sent", "bytes_recv", "total_retrans"),
    "src1_connections": lambda s, d: CA.connections(_classified(s, d)).select("sock_cookie", "ts_ns", "pid", "region", "srtt_us", "min_rtt_us", "sni"),
    "src2_src3_parse_accounting": lambda s, d: CA.accounting(_classified(s, d)),
    "src4_empty_capture_guard": lambda s, d: CA.require_records(_classified(s, d), ("operation",)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
    "src5_src6_access_trace": lambda s, d: AC.events(_access(s, d)),
    "src7_load_accounting": lambda s, d: AC.load_accounting(_access(s, d)),
    "src2_observed_accounting": lambda s, d: s.createDataFrame([CA.load(_classified(s, d))[1]]),
    "src2_observed_live_accounting": lambda s, d: W.run_counted(
        CA.classify(CA.read_line_stream(s, _capture(s, d)), NS, LINE_LIMIT), "counted-capture", CA.operations, CA.counts()
    )[1],
    "src7_observed_accounting": lambda s, d: s.createDataFrame([AC.load(_access(s, d))[1]]),
    "src8_findings_sink": lambda s, d: _sunk(s, d, "findings").select(
        "finding_id", "severity", F.array_join("source_schema", "+").alias("sources"), F.col("value_num"), "sample.judged", "scope.bucket", "scope.s3_op", "window.ts_start", "emitted_at", "recommendation_ref"
    ),
    "src9_scorecard_sink": lambda s, d: _sunk(s, d, "scorecard").select("bucket", "s3_op", "ops", "errors", "ttfb_p50_ns", F.col("window.ts_end").alias("ts_end")),
    "geo1_geo2_top2_latency_map": lambda s, d: G.latency_map(T.conns(s, d), GEO),
    "top2_placement": lambda s, d: G.placement(G.latency_map(T.conns(s, d), GEO), GEO),
    "geo3_triage": lambda s, d: G.triage(_bucket_ms(s, d), G.latency_map(T.conns(s, d), GEO), GEO),
}

_I = "CAST(op_id AS BIGINT)"
_OUT = f"""oc AS (SELECT *, CASE WHEN {_I} % 97 = 0 THEN 'bad' WHEN {_I} % 89 = 0 THEN 'unknown' WHEN {_I} % 83 = 0 THEN 'bad' WHEN {_I} % 79 = 0 THEN 'blank'
 WHEN {_I} % 73 = 0 THEN 'bad' WHEN {_I} % 71 = 0 THEN 'bad' WHEN {_I} % 997 = 5 THEN 'bad' ELSE 'operation' END AS outcome FROM ops)"""
_ACC = f"""al AS (SELECT *, {_I} AS i FROM ops), ax AS (
 SELECT i, CASE WHEN partial OR bucket IS NULL OR (s3_op = 'GetObject' AND (http_status IS NULL OR http_status NOT IN (200, 206))) THEN 'operation_dropped' ELSE 'event' END AS outcome, ts_ns,
  CASE s3_op WHEN 'GetObject' THEN 'get' WHEN 'HeadObject' THEN 'head' WHEN 'PutObject' THEN 'put' ELSE 'other' END AS op, bucket || '/' || key_hash AS object_id, NULL::BIGINT AS range_start, NULL::BIGINT AS range_end,
  content_length AS size, http_status AS status FROM al WHERE i % 4 = 0
 UNION ALL SELECT i, 'event', ts_ns, lower(verb), coalesce(bucket, 'none') || '/' || key_hash, CASE WHEN i % 2 = 0 THEN 0 END, CASE WHEN i % 2 = 0 THEN total_ns END, content_length, NULL FROM al WHERE i % 4 = 1
 UNION ALL SELECT i, 'event', (ts_ns // 1000000) * 1000000, CASE WHEN i % 5 = 0 THEN 'other' ELSE lower(verb) END, 'x/' || key_hash,
  CASE WHEN i % 7 = 0 AND content_length IS NOT NULL THEN 10 WHEN content_length IS NOT NULL THEN 0 END, CASE WHEN i % 7 = 0 AND content_length IS NOT NULL THEN 99 WHEN content_length IS NOT NULL THEN content_length - 1 END, NULL, NULL FROM al WHERE i % 4 = 2
 UNION ALL SELECT i, CASE WHEN i % 10 = 3 THEN 'other_record' ELSE 'unusable' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM al WHERE i % 4 = 3)"""
_CITY = """CASE region WHEN 'x' THEN '' ELSE region END"""
_MAP = f"""m AS (SELECT region, count(*) AS conns, {S.mid('(live_srtt / 1e3)')} AS floor_ms, {S.mid('(rttvar_us / 1e3)', 'rttvar_us > 0')} AS jitter_ms FROM connf WHERE region IS NOT NULL GROUP BY 1),
mm AS (SELECT region, region AS city, conns, floor_ms, jitter_ms, CAST(row_number() OVER (ORDER BY floor_ms, region) AS INTEGER) AS rank, floor_ms - min(floor_ms) OVER () AS vs_nearest_ms,
 CASE WHEN floor_ms < 5 THEN '~in-region' WHEN floor_ms < 40 THEN '~regional' WHEN floor_ms < 100 THEN '~long-haul' ELSE '~global' END AS band,
 CASE WHEN jitter_ms > 2.0 AND (jitter_ms > 0.15::DOUBLE * floor_ms OR jitter_ms > 15) THEN 'variable path' WHEN jitter_ms IS NOT NULL THEN 'steady' END AS stability FROM m)"""

ORACLES = {
    "src1_capture_scan": f"WITH {S.OPS}, {_OUT} SELECT op_id, ts_ns, sock_cookie, pid, s3_op, bucket, http_status, ttfb_ns, partial FROM oc WHERE outcome = 'operation'",
    "src10_live_capture": f"WITH {S.OPS}, {_OUT} SELECT op_id, ts_ns, sock_cookie, pid, s3_op, bucket, http_status, ttfb_ns, partial FROM oc WHERE outcome = 'operation'",
    "src1_samples": f"WITH {S.SAMPLES} SELECT sock_cookie, ts_ns, bytes_sent, bytes_recv, total_retrans FROM samples",
    "src1_connections": f"WITH {S.CONNS} SELECT sock_cookie, ts_ns, pid, region, srtt_us, min_rtt_us, sni FROM conns",
    "src2_src3_parse_accounting": f"""WITH {S.OPS}, {S.CONNS}, {_OUT} SELECT count(*) FILTER (WHERE outcome = 'operation') AS operations, (SELECT count(*) FROM conns) AS connections, (SELECT count(*) FROM lineitem) AS samples,
 count(*) FILTER (WHERE outcome = 'bad') AS bad_lines, count(*) FILTER (WHERE outcome = 'unknown') AS unknown_schema FROM oc""",
    "src4_empty_capture_guard": f"WITH {S.OPS}, {S.CONNS}, {_OUT} SELECT outcome, count(*) AS n FROM oc GROUP BY 1 UNION ALL SELECT 'connection', count(*) FROM conns UNION ALL SELECT 'sample', count(*) FROM lineitem",
    "src5_src6_access_trace": f"WITH {S.OPS}, {_ACC} SELECT ts_ns, op, object_id, range_start, range_end, size, CAST(status AS INTEGER) AS status FROM ax WHERE outcome = 'event'",
    "src7_load_accounting": f"""WITH {S.OPS}, {_ACC} SELECT count(*) FILTER (WHERE outcome = 'event') AS events, count(*) FILTER (WHERE outcome <> 'event') AS skipped,
 count(*) FILTER (WHERE outcome = 'operation_dropped') AS operations_dropped, count(*) FILTER (WHERE outcome = 'other_record') AS other_records FROM ax""",
    "src8_findings_sink": "",
    "src9_scorecard_sink": "",
    "geo1_geo2_top2_latency_map": f"WITH {S.CONNS}, {_MAP} SELECT * FROM mm",
    "top2_placement": f"""WITH {S.CONNS}, {_MAP}, n AS (SELECT count(*) AS regions, arg_min(region, floor_ms) AS nearest, min(floor_ms) AS nearest_ms, max(region) FILTER (WHERE rank = 2) AS runner_up,
 max(floor_ms) FILTER (WHERE rank = 2) - min(floor_ms) AS runner_up_gap_ms, arg_max(region, floor_ms) AS farthest, max(floor_ms) - min(floor_ms) AS spread_ms, max(floor_ms) / min(floor_ms) AS spread_ratio FROM mm)
 SELECT n.*, CAST((SELECT count(*) FROM mm, n WHERE floor_ms <= nearest_ms + greatest(1.0::DOUBLE, 0.25::DOUBLE * nearest_ms)) AS INTEGER) AS clustered FROM n""",
    "geo3_triage": f"""WITH {S.OPS}, {S.CONNS}, {_MAP}, b AS (SELECT bucket, {S.mid('(c.srtt_us / 1e3)')} AS bucket_ms FROM ops o JOIN conns c USING (sock_cookie) WHERE bucket IS NOT NULL AND c.srtt_us > 0 GROUP BY 1),
 n AS (SELECT region AS nearest, floor_ms AS nearest_ms FROM mm WHERE rank = 1),
 k AS (SELECT bucket, bucket_ms, (SELECT min({{'d': abs(floor_ms - bucket_ms), 'f': floor_ms, 'r': region}}) FROM mm) AS c FROM b)
 SELECT bucket, bucket_ms, nearest, nearest_ms, bucket_ms - nearest_ms AS avoidable_ms, CASE WHEN c.r <> nearest AND c.d <= 0.25::DOUBLE * bucket_ms THEN c.r END AS similar_to FROM k, n
 WHERE bucket_ms - nearest_ms >= 0.5 AND bucket_ms >= 1.3::DOUBLE * nearest_ms""",
}
from tidemark.catalog.scorecard import ORACLES as _SC  # noqa: E402

ORACLES["src8_findings_sink"] = f"SELECT finding_id, severity, 'tidemark.operation/1+tidemark.connection/2' AS sources, value_num, judged, bucket, s3_op, CAST(ts_start AS VARCHAR) AS ts_start, '2024-06-01T00:00:00Z' AS emitted_at, 'advice/' || finding_id AS recommendation_ref FROM ({_SC['sco2_reliability_findings']})"
ORACLES["src9_scorecard_sink"] = f"SELECT bucket, s3_op, ops, errors, ttfb_p50_ns, CAST(ts_end AS VARCHAR) AS ts_end FROM ({_SC['sco1_scorecard']})"
ORACLES |= {"src2_observed_accounting": ORACLES["src2_src3_parse_accounting"], "src2_observed_live_accounting": ORACLES["src2_src3_parse_accounting"], "src7_observed_accounting": ORACLES["src7_load_accounting"]}
