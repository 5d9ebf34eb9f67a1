from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.config import DEFAULT
from tidemark.plans import advise as A
from tidemark.plans import findings as FD
from tidemark.session import materialize
from tidemark.sources import tables as T

# requests of the driver tables are minutes apart: windows and floors are parameters
H6 = 6 * 3600 * 1_000_000_000
CFG = replace(
    DEFAULT, churn_single_shot=0.2, churn_untimed_max=0.3, serial_overlap_ceil=0.5, serial_busy_window_frac=0.001,
    refetch_repeats=1, refetch_redundant=5, pair_window_ns=H6, min_pairs=1, pair_ratio_floor=0.0, min_tiny_gets=20,
    overhead_floor_ns=100_000_000, recovery_window_ns=H6, rtt_report_floor_us=2000,
)
FLEET = replace(CFG, adv_min_ops=100_000, fleet_single_shot=0.2)


def _quick(s, d):
    """Bodies served in half their time to first byte, so that overhead can dominate."""
    return T.ops(s, d).withColumn("download_ns", F.expr("CASE WHEN download_ns IS NOT NULL THEN ttfb_ns div 2 END"))


def _fleet(s, d):
    return T.ops(s, d).withColumn("pid", F.col("sock_cookie").cast("bigint"))


def _all(s, d):
    return materialize(A.advise(_quick(s, d), T.conns(s, d), CFG), "advice")


QUERIES = {
    "adv1_ts13_connection_churn": lambda s, d: FD.flatten(A.connection_churn(T.ops(s, d), CFG)),
    "adv1_churn_untimed": lambda s, d: FD.flatten(A.connection_churn(T.ops(s, d), replace(CFG, churn_untimed_max=0.2))),
    "adv2_process_per_request": lambda s, d: FD.flatten(A.process_per_request(_fleet(s, d), FLEET)),
    "adv3_serial_requests": lambda s, d: FD.flatten(A.serial_requests(T.ops(s, d), CFG)),
    "ts12_concurrency_sweep": lambda s, d: A.concurrency(T.ops(s, d).where("s3_op = 'GetObject' AND total_ns > 0")),
    "jn3_write_epoch_runs": lambda s, d: A.read_runs(T.ops(s, d)),
    "adv4_top4_redundant_refetch": lambda s, d: FD.flatten(A.redundant_refetch(T.ops(s, d), CFG)),
    "jn4_head_claims": lambda s, d: A.head_claims(T.ops(s, d), CFG),
    "adv5_head_then_get": lambda s, d: FD.flatten(A.head_then_get(T.ops(s, d), CFG)),
    "adv6_small_objects": lambda s, d: FD.flatten(A.small_objects(_quick(s, d), CFG)),
    "jn5_throttle_recovery": lambda s, d: A.throttle_recovery(T.ops(s, d), CFG),
    "adv7_throttling": lambda s, d: FD.flatten(A.throttling(T.ops(s, d), CFG)),
    "adv8_adv9_latency_path": lambda s, d: FD.flatten(A.latency_path(T.conns(s, d), CFG)),
    "adv14_set1_advisory_union": lambda s, d: _all(s, d).groupBy("finding_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("judged").alias("judged")),
    "adv15_advisory_gate": lambda s, d: A.gate(_all(s, d), T.ops(s, d)),
    "adv15_run_row": lambda s, d: FD.flatten(A.run_row(T.ops(s, d).withColumn("http_status", F.lit(None).cast("int")), T.conns(s, d))),
    "set2_distinct": lambda s, d: T.ops(s, d).agg(
        F.count_distinct("pid").alias("pids"), F.count_distinct("sock_cookie").alias("sockets"), F.count_distinct("bucket", "key_hash").alias("objects")
    ),
}

_COLS = """, NULL::VARCHAR AS verdict, NULL::BIGINT AS baseline_rtt_us, NULL::DOUBLE AS ratio_to_rtt, NULL::VARCHAR AS s3_op, NULL::VARCHAR AS bucket, NULL::VARCHAR AS prefix_hash"""


def _row(fid, sev, metric, value, unit, judged, excluded, src, *, pid="NULL", text="NULL", region="NULL", domain="client", kind="operation", start="ts_start", end="ts_end", where="true"):
    return f"""SELECT {fid} AS finding_id, {sev} AS severity, {metric} AS metric, CAST({value} AS DOUBLE) AS value_num, {unit} AS unit, CAST({judged} AS BIGINT) AS judged,
 CAST({excluded} AS BIGINT) AS excluded, CAST({pid} AS BIGINT) AS app_pid, CAST({text} AS VARCHAR) AS value_str, CAST({region} AS VARCHAR) AS region, '{domain}' AS domain,
 '{kind}' AS sample_kind, CAST({start} AS BIGINT) AS ts_start, CAST({end} AS BIGINT) AS ts_end {_COLS} FROM {src} WHERE {where}"""


def _churn(pid: str = "pid") -> str:
    return f"""ch AS (SELECT {pid} AS pid, count(*) AS n, count(*) FILTER (WHERE partial) AS partials, count(*) FILTER (WHERE fr) AS fresh, count(*) FILTER (WHERE fr AND tcp_connect_ns IS NOT NULL) AS timed,
 coalesce(sum(cost) FILTER (WHERE fr AND tcp_connect_ns IS NOT NULL), 0) AS cost_ns, coalesce(arg_min(cost, ts_ns) FILTER (WHERE fr), 0) AS early, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end
 FROM (SELECT *, NOT connection_reused AND NOT partial AS fr, coalesce(tcp_connect_ns, 0) + coalesce(tls_handshake_ns, 0) AS cost FROM ops) WHERE s3_op IN ('GetObject', 'PutObject') GROUP BY 1)"""


def _churn_rows(limit: str) -> str:
    blind = f"(fresh - timed > {limit}::DOUBLE * fresh)"
    waste = "greatest(cost_ns - early, 0) / 1e6"
    return f"WITH {S.OPS}, {_churn()} " + _row(
        "'advisor-connection-churn'", f"CASE WHEN {blind} THEN 'unjudged' ELSE 'advisory' END", f"CASE WHEN {blind} THEN 'single_shot_frac' ELSE 'wasted_connect_ms' END",
        f"CASE WHEN {blind} THEN fresh / n ELSE {waste} END", f"CASE WHEN {blind} THEN 'ratio' ELSE 'ms' END", "n", "fresh - timed + partials", "ch", pid="pid",
        where=f"n >= 50 AND fresh / n > 0.2 AND ({blind} OR {waste} >= 500)",
    )


_SWEEP = """iv AS (SELECT pid, sock_cookie, ts_ns AS a, ts_ns + total_ns AS b FROM {src}),
mg AS (SELECT *, max(b) OVER (PARTITION BY pid, sock_cookie ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM iv),
isl AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY pid, sock_cookie ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM mg),
u AS (SELECT pid, sock_cookie, i, min(a) AS a, max(b) AS b FROM isl GROUP BY 1, 2, 3),
pt AS (SELECT pid, t, sum(d) AS d FROM (SELECT pid, a AS t, 1 AS d FROM u UNION ALL SELECT pid, b, -1 FROM u) GROUP BY 1, 2),
rn AS (SELECT pid, t, sum(d) OVER (PARTITION BY pid ORDER BY t) AS c, lead(t) OVER (PARTITION BY pid ORDER BY t) AS nt FROM pt),
sw AS (SELECT pid, CAST(coalesce(sum(nt - t) FILTER (WHERE c >= 1), 0) AS BIGINT) AS busy_ns, CAST(coalesce(sum(nt - t) FILTER (WHERE c >= 2), 0) AS BIGINT) AS overlap_ns FROM rn GROUP BY 1)"""
_GETS = """gt AS (SELECT *, NOT partial AND delimitation = 'clean' AS jd FROM ops WHERE s3_op = 'GetObject'), jg AS (SELECT * FROM gt WHERE jd AND total_ns > 0)"""
_EPOCH = """ev AS (SELECT coalesce('=' || bucket, '-') || '/' || key_hash AS obj, ts_ns, op_id, pid, content_length AS size, s3_op = 'PutObject' AS w FROM ops
 WHERE s3_op = 'PutObject' OR (s3_op = 'GetObject' AND http_status = 200 AND NOT partial)),
ep AS (SELECT *, coalesce(sum(CAST(w AS INTEGER)) OVER (PARTITION BY obj ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM ev),
rr AS (SELECT pid, obj, CAST(epoch AS BIGINT) AS epoch, count(*) AS reads, CAST(coalesce(sum(size), 0) - coalesce((arg_min({'s': size}, ts_ns)).s, 0) AS BIGINT) AS repeat_bytes,
 count(*) FILTER (WHERE size IS NULL) - CASE WHEN (arg_min({'s': size}, ts_ns)).s IS NULL THEN 1 ELSE 0 END AS repeat_unsized, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM ep WHERE NOT w GROUP BY 1, 2, 3)"""
_CLAIM = f"""hg AS (SELECT pid, coalesce('=' || bucket, '-') || '/' || key_hash AS obj, ts_ns, op_id, s3_op = 'HeadObject' AS hd, CASE WHEN NOT partial AND delimitation = 'clean' THEN total_ns END AS tm FROM ops WHERE s3_op IN ('HeadObject', 'GetObject')),
cl AS (SELECT g.pid, g.obj, g.ts_ns, min(h.ts_ns) AS head_ts FROM hg g JOIN hg h ON g.pid = h.pid AND g.obj = h.obj AND h.hd AND NOT g.hd AND h.ts_ns < g.ts_ns AND h.ts_ns >= g.ts_ns - {H6} GROUP BY 1, 2, 3),
hc AS (SELECT c.pid, c.obj, c.head_ts, h.tm AS head_ns, c.reads FROM (SELECT pid, obj, head_ts, count(*) AS reads FROM cl GROUP BY 1, 2, 3) c JOIN hg h ON c.pid = h.pid AND c.obj = h.obj AND h.hd AND h.ts_ns = c.head_ts)"""
_REC = f"""an AS (SELECT op_id, pid, coalesce(bucket, '-') AS b, key_hash, ts_ns, http_status FROM ops WHERE http_status IS NOT NULL),
th AS (SELECT op_id, pid, ts_ns, CASE WHEN ts_ns + {H6} <= (SELECT max(ts_ns) FROM an) THEN EXISTS (SELECT 1 FROM an o WHERE o.http_status < 400 AND o.pid = t.pid AND o.b = t.b AND o.key_hash = t.key_hash
  AND o.ts_ns > t.ts_ns AND o.ts_ns <= t.ts_ns + {H6}) END AS recovered FROM an t WHERE http_status = 503)"""
_SMALL = f"""sm AS (SELECT pid, count(*) AS total, count(*) FILTER (WHERE tm) AS n, count(content_length) FILTER (WHERE tm) AS sized, coalesce(sum(ttfb_ns) FILTER (WHERE tm), 0) AS ttfb,
 coalesce(sum(dl) FILTER (WHERE tm), 0) AS dl, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end, {S.upper('content_length', 'tm')} AS med FROM
 (SELECT *, ttfb_ns // 2 AS dl, delimitation = 'clean' AND NOT partial AND download_ns IS NOT NULL AS tm FROM ops WHERE s3_op = 'GetObject' AND http_status = 200) GROUP BY 1)"""
_PATHS = f"""pa AS (SELECT endpoint_ip AS ip, count(*) AS n, count(live_min) AS usable, bool_or(cross_region) AS crs, bool_or(via_vpce) AS vp, min(pid) AS p0, max(pid) AS p1,
 arg_min(region, ts_ns) AS region, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end, {S.upper('live_min')} AS med FROM connf GROUP BY 1),
pk AS (SELECT *, CASE WHEN crs THEN 'cross' WHEN usable < 5 AND n >= 5 THEN 'blind' WHEN usable >= 5 AND med >= 2000 AND vp THEN 'vpce' WHEN usable >= 5 AND med >= 2000 THEN 'high' END AS kind FROM pa)"""

_ADV3 = f"""{S.OPS}, {_GETS}, {_SWEEP.format(src='jg')},
sq AS (SELECT p.*, busy_ns, overlap_ns FROM (SELECT pid, count(*) AS seen, count(*) FILTER (WHERE jd) AS n, min(ts_ns) FILTER (WHERE jd) AS ts_start, max(ts_ns) FILTER (WHERE jd) AS ts_end,
 max(ts_ns + total_ns) FILTER (WHERE jd) AS last FROM gt GROUP BY 1) p JOIN sw USING (pid))"""
R = {
    "adv3": _row("'advisor-serial-requests'", "'advisory'", "'serialized_busy_ms'", "busy_ns / 1e6", "'ms'", "n", "seen - n", "sq", pid="pid",
                 where="seen >= 50 AND NOT seen - n > 0.2::DOUBLE * seen AND n >= 50 AND busy_ns >= greatest(10000000000, floor(0.001::DOUBLE * (last - ts_start))) AND overlap_ns / busy_ns < 0.5"),
    "adv4": _row("'advisor-redundant-refetch'", "'advisory'", "'wasted_bytes'", "bytes", "'none'", "gets", "unsized + coalesce(left_out, 0)", "fp", pid="pid",
                 text="objects || ' ' || redundant || ' ' || top", where="gets >= 50 AND objects > 0 AND (bytes >= 104857600 OR redundant >= 5)"),
    "adv5": _row("'advisor-head-then-get'", "CASE WHEN untimed > 0.2::DOUBLE * pairs THEN 'unjudged' ELSE 'advisory' END", "'head_get_pairs'", "pairs", "'count'", "both_n", "untimed", "hp", pid="pid",
                 text="CAST(wasted AS DECIMAL(20, 3))"),
    "adv6": _row("'advisor-small-objects'", "'advisory'", "'overhead_fraction'", "ttfb / greatest(ttfb + dl, 1)", "'ratio'", "n", "total - n + n - sized", "sm", pid="pid",
                 where="total >= 20 AND NOT total - n > 0.2::DOUBLE * total AND n >= 20 AND sized / n >= 0.8 AND med <= 262144 AND ttfb >= dl AND ttfb >= 100000000"),
    "adv7": _row("'advisor-throttling'", "CASE WHEN no > 0 THEN 'warn' WHEN yes > 0 THEN 'advisory' ELSE 'unjudged' END", "'rate_503'", "thr / n", "'ratio'", "n", "seen - n", "tz", domain="s3",
                 text="yes || '/' || no || '/' || opn", where="n >= 50 AND thr >= 5 AND thr / n > 0.01"),
    "adv89": _row("CASE kind WHEN 'cross' THEN 'advisor-latency-cross-region' WHEN 'high' THEN 'advisor-latency-high-rtt' ELSE 'advisor-latency-unjudged' END",
                  "CASE WHEN kind = 'cross' THEN 'advisory' ELSE 'unjudged' END", "CASE kind WHEN 'cross' THEN 'connections' WHEN 'blind' THEN 'rtt_samples' ELSE 'median_min_rtt_us' END",
                  "CASE kind WHEN 'cross' THEN n WHEN 'blind' THEN usable ELSE med END", "CASE WHEN kind IN ('vpce', 'high') THEN 'us' ELSE 'count' END",
                  "CASE WHEN kind = 'cross' THEN n ELSE usable END", "CASE WHEN kind = 'cross' THEN 0 ELSE n - usable END", "pk", pid="CASE WHEN p0 = p1 THEN p0 END", text="ip",
                  region="CASE WHEN kind = 'cross' THEN region END", domain="network", kind="connection", where="kind IS NOT NULL"),
}
_FP = f"""{_EPOCH}, fo AS (SELECT pid, obj, sum(reads) AS gets, max(reads) AS longest, sum(reads - 1) AS redundant, sum(repeat_bytes) AS bytes, sum(repeat_unsized) AS unsized, min(first_ts) AS a, max(last_ts) AS z FROM rr GROUP BY 1, 2),
lo AS (SELECT pid, count(*) FILTER (WHERE partial AND s3_op = 'GetObject' AND http_status = 200) AS left_out FROM ops GROUP BY 1),
fp AS (SELECT f.*, left_out FROM (SELECT pid, sum(gets) AS gets, count(*) FILTER (WHERE longest > 1) AS objects, CAST(sum(redundant) FILTER (WHERE longest > 1) AS BIGINT) AS redundant, sum(bytes) FILTER (WHERE longest > 1) AS bytes,
 sum(unsized) FILTER (WHERE longest > 1) AS unsized, (max({{'b': bytes, 'r': redundant, 'o': obj}}) FILTER (WHERE longest > 1)).o AS top, min(a) AS ts_start, max(z) AS ts_end FROM fo GROUP BY 1) f LEFT JOIN lo USING (pid))"""
_HP = f"""{_CLAIM}, hp AS (SELECT * FROM (SELECT pid, count(*) AS pairs, count(*) FILTER (WHERE head_ns IS NULL) AS untimed, coalesce(sum(head_ns), 0) / 1e6 AS wasted FROM hc WHERE reads = 1 GROUP BY 1)
 JOIN (SELECT pid, count(*) AS both_n, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end FROM hg GROUP BY 1) USING (pid))"""
_TZ = f"""{_REC}, tz AS (SELECT (SELECT count(*) FROM ops) AS seen, count(*) AS n, count(*) FILTER (WHERE http_status = 503) AS thr, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end,
 (SELECT count(*) FILTER (WHERE recovered) FROM th) AS yes, (SELECT count(*) FILTER (WHERE NOT recovered) FROM th) AS no, (SELECT count(*) FILTER (WHERE recovered IS NULL) FROM th) AS opn FROM an)"""
_CH1 = _churn_rows("0.3")
_ALL = f"""WITH {_ADV3}, {S.CONNS}, {_churn()}, {_FP}, {_HP}, {_SMALL}, {_TZ}, {_PATHS}, allf AS ({_CH1[_CH1.rindex('SELECT ' + "'advisor"):]} UNION ALL {' UNION ALL '.join(R.values())})"""

ORACLES = {
    "adv1_ts13_connection_churn": _CH1,
    "adv1_churn_untimed": _churn_rows("0.2"),
    "adv2_process_per_request": f"WITH {S.OPS}, {_churn('CAST(sock_cookie AS BIGINT)')}, fl AS (SELECT count(*) AS pids, sum(n) AS n, sum(fresh) AS fresh, sum(partials) AS partials, min(ts_start) AS ts_start, max(ts_end) AS ts_end FROM ch) "
    + _row("'advisor-connection-churn'", "'advisory'", "'single_shot_frac'", "fresh / n", "'ratio'", "n", "partials", "fl", where="pids >= 20 AND fresh >= 100 AND fresh / n > 0.2"),
    "adv3_serial_requests": f"WITH {_ADV3} " + R["adv3"],
    "ts12_concurrency_sweep": f"WITH {S.OPS}, jg AS (SELECT * FROM ops WHERE s3_op = 'GetObject' AND total_ns > 0), {_SWEEP.format(src='jg')} SELECT * FROM sw",
    "jn3_write_epoch_runs": f"WITH {S.OPS}, {_EPOCH} SELECT * FROM rr",
    "adv4_top4_redundant_refetch": f"WITH {S.OPS}, {_FP} " + R["adv4"],
    "jn4_head_claims": f"WITH {S.OPS}, {_CLAIM} SELECT * FROM hc",
    "adv5_head_then_get": f"WITH {S.OPS}, {_HP} " + R["adv5"],
    "adv6_small_objects": f"WITH {S.OPS}, {_SMALL} " + R["adv6"],
    "jn5_throttle_recovery": f"WITH {S.OPS}, {_REC} SELECT * FROM th",
    "adv7_throttling": f"WITH {S.OPS}, {_TZ} " + R["adv7"],
    "adv8_adv9_latency_path": f"WITH {S.CONNS}, {_PATHS} " + R["adv89"],
    "adv14_set1_advisory_union": _ALL + " SELECT finding_id, severity, count(*) AS n, CAST(sum(judged) AS BIGINT) AS judged FROM allf GROUP BY 1, 2",
    "adv15_advisory_gate": _ALL + """ SELECT count(*) AS findings, count(*) FILTER (WHERE severity IN ('warn', 'advisory')) AS raised, count(*) FILTER (WHERE severity = 'unjudged') AS unjudged,
 (SELECT count(*) FROM ops) AS operations, (SELECT count(http_status) FROM ops) AS answered, 0 AS exit_code, 1 AS exit_code_strict FROM allf""",
    "adv15_run_row": f"WITH {S.OPS}, {S.CONNS}, rw AS (SELECT (SELECT count(*) FROM ops) AS seen, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end FROM (SELECT ts_ns FROM ops UNION ALL SELECT ts_ns FROM conns)) "
    + _row("'advisor-run'", "'unjudged'", "'judgeable_operations'", "0", "'count'", "0", "seen", "rw", domain="run"),
    "set2_distinct": f"WITH {S.OPS} SELECT count(DISTINCT pid) AS pids, count(DISTINCT sock_cookie) AS sockets, count(DISTINCT bucket || key_hash) AS objects FROM ops",
}
