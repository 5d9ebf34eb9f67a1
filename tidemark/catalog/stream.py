from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.catalog import timeseries as _TS
from tidemark.catalog.scorecard import ORACLES as _SC
from tidemark.plans import correlate as CR
from tidemark.plans import scorecard as SC
from tidemark.plans import study as ST
from tidemark.session import scratch_path
from tidemark.sources import tables as T
from tidemark.streaming import correlation as SR
from tidemark.streaming import counters as CN
from tidemark.streaming import enrich as EN
from tidemark.streaming import summaries as SU
from tidemark.streaming import windows as W

HOT_SHARE = 0.005  # of the reads
SOCKET_MEMORY = 3  # days


def _e(s, d):
    return T.base_events(s, d)


def _live(s, d):
    return T.event_columns(W.table_stream(s, d, "events"))


def _fd(e):
    return e.selectExpr("user_id % 8 AS pid", "k % 5 AS fd", "ts_ns", "event_id AS seq", "CAST(user_id AS STRING) AS sock_cookie", "event_type")


def _pairs(s, d):
    return CR.dns_pairs(T.dns_events(_e(s, d)))


def _wire(s, d):
    return _pairs(s, d).select(F.col("qname").alias("host"), "query_ts", "resolved_ts").distinct()


def _left_waiting(s, d):
    """What the correlation's state holds when the stream stops: events that the watermark has not passed."""
    log = scratch_path(s, "waiting-log")
    W.drain(SR.correlate_stream(T.wire_events(_live(s, d)), timeout_ms=10**13, late_by="10 hours"), scratch_path(s, "waiting"), log)
    return SR.state_table(log, s, "waiting")


def _late(s, d):
    """Every event, and whether the watermark of a day had passed it when it arrived."""
    on_time, late = W.split_late(W.arrival_stream(T.with_turns(_e(s, d)), "turn", "arrivals"), "late", 86_400_000_000_000)
    return on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).select("event_id", "ts_ns", "late")


def _live_trace(s, d):
    return T.demand_trace(T.ops_from(_live(s, d)))


def _gains(s, d):
    samples = W.folder_stream(T.numbered_samples(T.samples(s, d)), "numbered")
    return W.run_to_end(lambda ticks: CN.gain_windows(samples, ticks, timeout_ms=10**12), s, "gains").drop("batch")


def _live_samples(s, d):
    li = W.table_stream(s, d, "lineitem")
    return li.selectExpr(
        "CAST(l_suppkey AS STRING) AS sock_cookie",
        "(unix_micros(CAST(l_shipdate AS TIMESTAMP)) div 86400000000) * 100000000 + (l_orderkey * 7919 + l_linenumber * 104729) % 100000000 AS ts_ns",
        "CAST(round(l_tax * 100000) + 1000 AS BIGINT) AS srtt_us",
    )


QUERIES = {
    "jn6_dns_query_response": lambda s, d: _pairs(s, d).select("sock_cookie", "txn_id", "qname", "query_ts", "resolved_ts", "latency_ns", "n_answers", "ip", "ttl_s"),
    "jn7_dns_asof_connect": lambda s, d: CR.connection_dns(T.connects(_e(s, d)), _pairs(s, d), T.lookups(_e(s, d))),
    "jn8_resolver_cache_hits": lambda s, d: CR.lookup_cache_hits(T.lookups(_e(s, d)), _wire(s, d)),
    "jn9_connect_close": lambda s, d: CR.connect_close(T.socket_events(_e(s, d)).where("kind IN ('connect', 'close')")),
    "jn10_tls_facts": lambda s, d: CR.tls_facts(T.socket_events(_e(s, d))),
    "jn11_fd_asof_cookie": lambda s, d: CR.fd_links(
        _fd(_e(s, d)).where("event_type = 'click'").drop("sock_cookie", "event_type"), _fd(_e(s, d)).where("event_type = 'purchase'").drop("event_type")
    ),
    "ts14_request_sequence": lambda s, d: CR.request_sequence(T.wire_events(_e(s, d)).where("kind = 'request'")),
    "str1_correlated_requests": lambda s, d: CR.correlate_requests(T.wire_events(_e(s, d))),
    "str1_str5_live_correlation": lambda s, d: W.run_once(SR.correlate_stream(T.wire_events(_live(s, d)), timeout_ms=10**13), "live-requests", end=SR.end_of_requests).drop("batch"),
    "str2_str3_live_connections": lambda s, d: W.run_once(
        SR.connection_stream(T.socket_events(_live(s, d)).where("kind IN ('connect', 'close')")), "live-conns", end=SR.end_of_connections
    ).drop("batch"),
    "str2_enriched_connections": lambda s, d: CR.enriched_connections(T.peer_sockets(_e(s, d)), T.address_answers(_e(s, d)), T.address_regions(s, d)),
    "str2_live_enriched_connections": lambda s, d: W.run_to_end(
        lambda ticks: EN.enriched_stream(T.peer_sockets(_live(s, d)), T.address_answers(_live(s, d)), T.address_regions(s, d), ticks), s, "enriched"
    ).drop("batch"),
    "str4_waiting_events": lambda s, d: _left_waiting(s, d),
    "str6_sample_windows": lambda s, d: W.latest(W.run_once(W.sample_windows(_live_samples(s, d)), "sample-windows", "update"), ["start_us"]),
    "str7_windowed_scorecard": lambda s, d: W.latest(
        W.run_once(W.scorecard_windows(T.ops_from(_live(s, d))), "scorecard-windows", "update"), ["start_us", "bucket", "s3_op"]
    ),
    "str7_sliding_percentiles": lambda s, d: W.merged_windows(
        W.latest(W.run_once(W.scorecard_panes(T.ops_from(_live(s, d))), "panes", "update"), ["start_us", "end_us", "bucket", "s3_op"]), 7, {"p50_ns": 0.5, "p95_ns": 0.95}
    ),
    "str8_src10_live_scorecard": lambda s, d: W.landed(T.ops_from(_live(s, d)), "landed", SC.scorecard)
    .withColumn("status_counts", SC.status_text(F.col("status_counts")))
    .drop("p99_over_p50", "group_total"),
    "str8_merged_scorecard": lambda s, d: SU.merged_scorecard(SU.collect_parts(T.ops_from(_live(s, d)), "parts", SU.scorecard_parts))
    .withColumn("status_counts", SC.status_text(F.col("status_counts")))
    .drop("p99_over_p50", "group_total"),
    "str3_late_rows": _late,
    "str6_ts1_counter_windows": _gains,
    "str6_set2_socket_movement": lambda s, d: SU.socket_movement(
        W.latest(W.run_once(SU.socket_panes(T.ops_from(_live(s, d))), "socket-panes", "update"), ["start_us", "end_us"]), SOCKET_MEMORY
    ),
    "seq5_live_hot_objects": lambda s, d: SU.hot_objects(
        SU.collect_parts(ST.split_and_pooled(_live_trace(s, d)), "object-parts", lambda df: SU.object_parts(df, HOT_SHARE)), HOT_SHARE
    ),
}

_E = S.OPS
_DNS = _E + """,
dn AS (SELECT CAST(user_id % 10 AS VARCHAR) AS sock_cookie, k % 4 AS txn_id, ts_ns, event_id AS seq, event_type = 'click' AS isq, 'n' || (k % 2) AS qname, '10.9.0.' || (k % 30) AS ip, CAST(k AS BIGINT) AS ttl_s FROM e WHERE event_type IN ('click', 'view')),
dq AS (SELECT *, last_value(CASE WHEN isq THEN {'s': seq, 'n': qname, 't': ts_ns} END IGNORE NULLS) OVER (PARTITION BY sock_cookie, txn_id ORDER BY ts_ns, CASE WHEN isq THEN 0 ELSE 1 END, seq ROWS UNBOUNDED PRECEDING) AS q FROM dn),
pr AS (SELECT sock_cookie, txn_id, qname, (q).t AS query_ts, ts_ns AS resolved_ts, ts_ns - (q).t AS latency_ns, 1 AS n_answers, ip, ttl_s, seq FROM dq WHERE NOT isq AND (q).n = qname
  QUALIFY row_number() OVER (PARTITION BY sock_cookie, txn_id, (q).s ORDER BY ts_ns, seq) = 1),
lu AS (SELECT 'n' || (k % 2) AS host, ts_ns, event_id AS seq, CAST(round(value * 10000000000) AS BIGINT) AS latency_ns, k % 4 = 0 AS cache_hit FROM e WHERE event_type = 'signup')"""
_WIRE = _E + """,
wi AS (SELECT 'h' || (user_id % 3) || '/' || (user_id % 8) || '/' || user_id AS conn, ts_ns, event_id AS seq, CASE WHEN k = 50 THEN 'link' WHEN event_type IN ('click', 'purchase') THEN 'request' WHEN event_type = 'signup' THEN 'body' ELSE 'response' END AS kind,
 CASE WHEN k % 9 = 0 THEN 'HEAD' WHEN event_type = 'purchase' THEN 'PUT' ELSE 'GET' END AS verb, CASE WHEN k % 10 = 0 THEN 100 WHEN event_type = 'error' THEN 500 WHEN k % 13 = 0 THEN 204 ELSE 200 END AS st,
 CASE WHEN k % 4 <> 0 THEN CAST(k * 3 AS BIGINT) END AS cl, CASE WHEN event_type = 'signup' THEN k * 2 ELSE 200 + k END AS bytes, k % 17 <> 0 AS hc FROM e),
ep AS (SELECT *, sum(CASE WHEN kind IN ('request', 'link') THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS ep FROM wi),
hd AS (SELECT conn, ep, min({'t': ts_ns, 's': seq, 'k': kind, 'v': verb}) FILTER (WHERE kind IN ('request', 'link')) AS o, min({'t': ts_ns, 's': seq, 'st': st, 'cl': cl, 'b': bytes, 'hc': hc}) FILTER (WHERE kind = 'response' AND st >= 200) AS h FROM ep WHERE ep > 0 GROUP BY 1, 2),
h2 AS (SELECT hd.*, (SELECT min(ts_ns) FROM ep x WHERE x.conn = hd.conn AND x.ep = hd.ep AND x.kind = 'response' AND x.st < 200 AND (h IS NULL OR (x.ts_ns, x.seq) < ((h).t, (h).s))) AS it,
  (o).k = 'request' AND h IS NOT NULL AND coalesce((h).cl, 0) > 0 AND (o).v <> 'HEAD' AND (h).st NOT IN (204, 304) AND (h).hc AS ex FROM hd),
tl AS (SELECT e.conn, e.ep, e.ts_ns, (h).cl - greatest((h).b - 200, 0) AS need, sum(e.bytes) OVER (PARTITION BY e.conn, e.ep ORDER BY e.ts_ns, e.seq ROWS UNBOUNDED PRECEDING) AS got FROM ep e JOIN h2 ON e.conn = h2.conn AND e.ep = h2.ep
  WHERE ex AND e.kind IN ('response', 'body') AND (e.ts_ns, e.seq) > ((h).t, (h).s)),
dn AS (SELECT conn, ep, min(ts_ns) AS bt FROM tl WHERE need > 0 AND got >= need GROUP BY 1, 2),
rr AS (SELECT h2.*, CASE WHEN ex AND (h).cl - greatest((h).b - 200, 0) <= 0 THEN (h).t ELSE bt END AS bt, lag((o).k) OVER w AS pk, lag(h IS NULL) OVER w AS pu, lead((o).k) OVER w AS nk,
  max(CASE WHEN (o).k = 'link' THEN h2.ep END) OVER (PARTITION BY h2.conn ORDER BY h2.ep) AS ll FROM h2 LEFT JOIN dn ON h2.conn = dn.conn AND h2.ep = dn.ep WINDOW w AS (PARTITION BY h2.conn ORDER BY h2.ep)),
cr AS (SELECT conn, (o).s AS seq, (o).t AS ts_ns, (o).v AS verb, CAST(ep - coalesce(ll, 0) - 1 AS BIGINT) AS req_seq, (h).st AS http_status, (h).cl AS content_length, nullif(coalesce(it, (h).t) - (o).t, 0) AS ttfb_ns, bt - (h).t AS download_ns, bt - (o).t AS total_ns,
  coalesce(NOT (h).hc, false) AS partial, CASE WHEN (h IS NULL AND nk = 'request') OR coalesce(pk = 'request' AND pu, false) THEN 'ambiguous' ELSE 'clean' END AS delimitation,
  nk IS NULL AND (h IS NULL OR (ex AND bt IS NULL)) AS open FROM rr WHERE (o).k = 'request')"""
_SOCK = _E + """,
so AS (SELECT CAST(user_id AS VARCHAR) AS sock_cookie, ts_ns, event_id AS seq, user_id % 8 AS pid, CASE event_type WHEN 'purchase' THEN 'connect' WHEN 'signup' THEN 'close' ELSE event_type END AS kind,
 CASE WHEN event_type = 'click' THEN 'b' || (k % 5) || '.s3.eu-west-1.amazonaws.com' END AS sni, CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN 'TLSv1.' || (2 + k % 2) END AS tls_version,
 CASE WHEN event_type = 'view' AND k % 5 <> 0 THEN 4865 + k % 3 END AS cipher FROM e)"""
_E_SOCK = _SOCK + """,
pe AS (SELECT *, CASE WHEN kind = 'connect' THEN '10.9.0.' || (seq % 30) END AS ip FROM so WHERE kind <> 'error'),
an AS (SELECT '10.9.0.' || (k % 30) AS ip, ts_ns, event_id AS seq, 'n' || (k % 2) AS host FROM e WHERE event_type = 'view')"""
_CC = f"""WITH {_SOCK}, z AS (SELECT *, lag(kind) OVER w AS pk, lag(ts_ns) OVER w AS pt, lag(pid) OVER w AS pp FROM so WHERE kind IN ('connect', 'close') WINDOW w AS (PARTITION BY sock_cookie ORDER BY ts_ns, seq))
 SELECT seq, sock_cookie, CASE WHEN pk = 'connect' THEN pt END AS connect_ts, ts_ns AS close_ts, CASE WHEN pk = 'connect' THEN ts_ns - pt END AS lifetime_ns, CASE WHEN pk = 'connect' THEN pp ELSE 0 END AS pid, NOT coalesce(pk = 'connect', false) AS partial FROM z WHERE kind = 'close'"""

_ENRICHED = f"""WITH {_E_SOCK}, w AS (SELECT *, max(CASE WHEN kind = 'connect' THEN {{'t': ts_ns, 's': seq, 'p': pid, 'ip': ip}} END) OVER b AS o, max(CASE WHEN kind = 'close' THEN {{'t': ts_ns, 's': seq}} END) OVER b AS c,
  max(CASE WHEN sni IS NOT NULL THEN {{'t': ts_ns, 's': seq, 'v': sni}} END) OVER b AS f1, max(CASE WHEN tls_version IS NOT NULL THEN {{'t': ts_ns, 's': seq, 'v': tls_version}} END) OVER b AS f2,
  max(CASE WHEN cipher IS NOT NULL THEN {{'t': ts_ns, 's': seq, 'v': cipher}} END) OVER b AS f3 FROM pe WINDOW b AS (PARTITION BY sock_cookie ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, o IS NOT NULL AND ts_ns - (o).t <= {CR.MAX_LIFE_NS} AND (c IS NULL OR ((o).t, (o).s) > ((c).t, (c).s)) AS known FROM w WHERE kind = 'close'),
n AS (SELECT *, CASE WHEN known THEN (o).ip END AS cip, CASE WHEN known THEN (o).t END AS ct,
  (SELECT max({{'t': a.ts_ns, 's': a.seq, 'h': a.host}}) FROM an a WHERE known AND a.ip = (k.o).ip AND a.ts_ns <= (k.o).t AND (k.o).t - a.ts_ns <= {CR.RESOLVED_WITHIN_NS}) AS r FROM k)
SELECT sock_cookie, seq, ct AS connect_ts, ts_ns AS close_ts, ts_ns - ct AS lifetime_ns, CASE WHEN known THEN (o).p ELSE 0 END AS pid, NOT known AS partial, cip AS ip, region,
  CASE WHEN known AND ((f1).t, (f1).s) > ((o).t, (o).s) THEN (f1).v END AS sni, CASE WHEN known AND ((f2).t, (f2).s) > ((o).t, (o).s) THEN (f2).v END AS tls_version,
  CASE WHEN known AND ((f3).t, (f3).s) > ((o).t, (o).s) THEN (f3).v END AS cipher, (r).h AS host, ct - (r).t AS resolved_ago_ns
FROM n LEFT JOIN (SELECT '10.9.0.' || n_nationkey AS ip, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey) g ON g.ip = cip"""

ORACLES = {
    "str2_enriched_connections": _ENRICHED,
    "str2_live_enriched_connections": _ENRICHED,
    "str4_waiting_events": f"""WITH {_WIRE} SELECT conn, ts_ns, seq, kind, verb, CAST(st AS INT) AS http_status, cl AS content_length, CAST(bytes AS BIGINT) AS bytes, CAST(200 AS BIGINT) AS head_bytes, hc AS head_complete FROM wi
 WHERE ts_ns // 1000000 >= (SELECT max(ts_ns) // 1000000 - 36000000 FROM wi)""",
    "jn6_dns_query_response": f"WITH {_DNS} SELECT * EXCLUDE (seq) FROM pr",
    "jn7_dns_asof_connect": f"""WITH {_DNS}, co AS (SELECT '10.9.0.' || (k % 30) AS ip, ts_ns, event_id AS seq FROM e WHERE event_type = 'purchase'),
 a AS (SELECT co.*, (SELECT max({{'t': resolved_ts, 's': pr.seq, 'h': qname, 'l': latency_ns}}) FROM pr WHERE pr.ip = co.ip AND resolved_ts <= co.ts_ns) AS r FROM co),
 b AS (SELECT a.*, (SELECT max({{'t': lu.ts_ns, 's': lu.seq, 'l': latency_ns, 'c': cache_hit}}) FROM lu WHERE lu.host = (r).h AND lu.ts_ns <= a.ts_ns) AS g FROM a WHERE r IS NOT NULL)
 SELECT seq, ip, (r).h AS host, coalesce((g).l, (r).l) AS latency_ns, CASE WHEN g IS NOT NULL THEN 'getaddrinfo' ELSE 'wire' END AS via, coalesce((g).c, false) AS cache_hit FROM b""",
    "jn8_resolver_cache_hits": f"""WITH {_DNS} SELECT seq, host, ts_ns - latency_ns AS start, ts_ns AS "end", NOT EXISTS (SELECT 1 FROM pr WHERE qname = lu.host AND query_ts <= lu.ts_ns AND resolved_ts >= lu.ts_ns - lu.latency_ns) AS cache_hit FROM lu""",
    "jn9_connect_close": _CC,
    "jn10_tls_facts": f"""WITH {_SOCK}, z AS (SELECT *, sum(CASE WHEN kind = 'connect' THEN 1 ELSE 0 END) OVER (PARTITION BY sock_cookie ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS ep FROM so)
 SELECT sock_cookie, CAST(ep AS BIGINT) AS epoch, arg_max(sni, ts_ns) FILTER (WHERE sni IS NOT NULL) AS sni, arg_max(tls_version, ts_ns) FILTER (WHERE tls_version IS NOT NULL) AS tls_version, arg_max(cipher, ts_ns) FILTER (WHERE cipher IS NOT NULL) AS cipher FROM z GROUP BY 1, 2""",
    "jn11_fd_asof_cookie": f"""WITH {_E}, l AS (SELECT user_id % 8 AS pid, k % 5 AS fd, ts_ns, event_id AS seq, CAST(user_id AS VARCHAR) AS sock_cookie FROM e WHERE event_type = 'purchase'),
 u AS (SELECT user_id % 8 AS pid, k % 5 AS fd, ts_ns, event_id AS seq FROM e WHERE event_type = 'click')
 SELECT seq, pid, fd, (SELECT arg_max(l.sock_cookie, l.ts_ns) FROM l WHERE l.pid = u.pid AND l.fd = u.fd AND l.ts_ns <= u.ts_ns) AS sock_cookie FROM u""",
    "ts14_request_sequence": f"WITH {_WIRE} SELECT conn, seq, row_number() OVER (PARTITION BY conn ORDER BY ts_ns, seq) - 1 AS req_seq, row_number() OVER (PARTITION BY conn ORDER BY ts_ns, seq) > 1 AS connection_reused FROM wi WHERE kind = 'request'",
    "str1_correlated_requests": f"WITH {_WIRE} SELECT * FROM cr",
    "str1_str5_live_correlation": f"WITH {_WIRE} SELECT * EXCLUDE (open), open AS flushed FROM cr",
    "str2_str3_live_connections": _CC,
    "str6_sample_windows": """WITH z AS (SELECT (epoch_us(l_shipdate) // 86400000000) * 100000000 + (l_orderkey * 7919 + l_linenumber * 104729) % 100000000 AS ts_ns, CAST(round(l_tax * 100000) + 1000 AS BIGINT) AS srtt, l_suppkey AS cookie FROM lineitem)
 SELECT (ts_ns // 1000000000) * 1000000 AS start_us, count(*) AS samples, min(srtt) AS min_srtt_us, max(srtt) AS max_srtt_us, count(DISTINCT cookie) AS sockets FROM z GROUP BY 1""",
    "str7_windowed_scorecard": f"""WITH {S.OPS} SELECT (ts_ns // 86400000000000) * 86400000000 AS start_us, bucket, s3_op, count(http_status) AS ops, count(*) FILTER (WHERE http_status >= 400) AS errors,
 count(ttfb_ns) FILTER (WHERE good) AS latency_sample, count(*) FILTER (WHERE http_status IS NULL) AS unanswered,
 {S.pct('ttfb_ns', 0.5, 'good')} AS ttfb_p50_ns FROM opf GROUP BY 1, 2, 3""",
    "str7_sliding_percentiles": f"""WITH {S.OPS}, z AS (SELECT unnest(range(0, 7)) AS k, ts_ns // 86400000000000 AS day, * FROM opf),
 g AS (SELECT (day - k) * 86400000000 AS start_us, bucket, s3_op, count(http_status) AS ops, count(*) FILTER (WHERE http_status >= 400) AS errors, count(ttfb_ns) FILTER (WHERE good) AS latency_sample,
  list(ttfb_ns ORDER BY ttfb_ns) FILTER (WHERE good AND ttfb_ns IS NOT NULL) AS l FROM z GROUP BY 1, 2, 3)
 SELECT start_us, bucket, s3_op, CAST(ops AS BIGINT) AS ops, CAST(errors AS BIGINT) AS errors, CAST(latency_sample AS BIGINT) AS latency_sample,
  l[CAST(ceil(len(l) * 0.5::DOUBLE) AS BIGINT)] AS p50_ns, l[CAST(ceil(len(l) * 0.95::DOUBLE) AS BIGINT)] AS p95_ns FROM g""",
    "str8_src10_live_scorecard": _SC["sco1_scorecard"],
    "str8_merged_scorecard": _SC["sco1_scorecard"],
    "str3_late_rows": f"""WITH {_E}, a AS (SELECT event_id, ts_ns, (ts_ns + CAST(k AS BIGINT) * k * 60000000000) // 432000000000000 AS turn FROM e),
 t AS (SELECT turn, max(max(ts_ns)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS youngest FROM a GROUP BY 1)
 SELECT event_id, ts_ns, coalesce(ts_ns < youngest - 86400000000000, false) AS late FROM a JOIN t USING (turn)""",
    "str6_ts1_counter_windows": f"""WITH {_TS.SEG} SELECT (ts_ns // 1000000000) * 1000000 AS start_us, count(*) AS samples, count(*) FILTER (WHERE pts IS NULL) AS segments_begun,
 CAST(coalesce(sum(bytes_recv - pr), 0) AS BIGINT) AS received, CAST(coalesce(sum(bytes_sent - ps), 0) AS BIGINT) AS sent, CAST(coalesce(sum(total_retrans - pt), 0) AS BIGINT) AS retrans FROM seg GROUP BY 1""",
    "str6_set2_socket_movement": f"""WITH {S.OPS}, z AS (SELECT ts_ns // 86400000000000 AS day, sock_cookie, count(*) AS n FROM ops GROUP BY 1, 2),
 y AS (SELECT z.day, z.n, EXISTS (SELECT 1 FROM z o WHERE o.sock_cookie = z.sock_cookie AND o.day < z.day AND o.day >= z.day - {SOCKET_MEMORY}) AS known FROM z),
 g AS (SELECT day, CAST(sum(n) AS BIGINT) AS records, count(*) AS sockets, count(*) FILTER (WHERE known) AS returned, count(*) FILTER (WHERE NOT known) AS fresh FROM y GROUP BY 1)
 SELECT day * 86400000000 AS start_us, records, sockets, returned, fresh, (SELECT count(DISTINCT sock_cookie) FROM z WHERE z.day <= g.day AND z.day >= g.day - {SOCKET_MEMORY}) AS sockets_in_memory FROM g""",
    "seq5_live_hot_objects": f"""WITH {S.TRACE}, b AS (SELECT CAST(app AS VARCHAR) AS app, object_id FROM trace WHERE op = 'get' UNION ALL SELECT '*', object_id FROM trace WHERE op = 'get'),
 c AS (SELECT app, object_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY app) AS BIGINT) AS total FROM b GROUP BY 1, 2) SELECT * FROM c WHERE n >= {HOT_SHARE}::DOUBLE * total""",
}
