from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.config import DEFAULT
from tidemark.plans import findings as FD
from tidemark.plans import scorecard as SC
from tidemark.sources import tables as T

# the driver tables have a mild tail; the ratio is a parameter
TAIL = replace(DEFAULT, sc_tail_ratio=5.0, sc_min_errors=3)


def _scorecard(s, d):
    return SC.scorecard(T.ops(s, d)).withColumn("status_counts", SC.status_text(F.col("status_counts"))).drop("p99_over_p50", "group_total")


QUERIES = {
    "sco1_scorecard": _scorecard,
    "top5_ordered_scorecard": lambda s, d: SC.ordered(_scorecard(s, d)),
    "sco2_reliability_findings": lambda s, d: FD.flatten(SC.reliability_findings(T.ops(s, d), TAIL), with_evidence=True),
    "sco3_heavy_tail": lambda s, d: FD.flatten(SC.tail_findings(T.ops(s, d), TAIL), with_evidence=True),
    "sco4_unjudged_run": lambda s, d: FD.flatten(
        SC.unjudged_run(
            T.ops(s, d).withColumn("http_status", F.lit(None).cast("int")),
            SC.capture_window(T.ops(s, d), T.conns(s, d), T.sample_clock(s, d)),
        )
    ),
    "agg17_capture_window": lambda s, d: SC.capture_window(T.ops(s, d), T.conns(s, d), T.sample_clock(s, d)),
}

FLAT = """NULL::VARCHAR AS verdict, NULL::VARCHAR AS value_str, NULL::BIGINT AS baseline_rtt_us, NULL::DOUBLE AS ratio_to_rtt,
 NULL::VARCHAR AS prefix_hash, NULL::VARCHAR AS region, NULL::BIGINT AS app_pid"""

_GROUPS = """
g AS (SELECT bucket, s3_op, count(http_status) AS ops, count(*) AS group_total, count(*) FILTER (WHERE http_status >= 400) AS errors,
  count(*) FILTER (WHERE good AND ttfb_ns IS NOT NULL) AS latency_sample, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end,
  """ + S.mid("ttfb_ns", "good") + " AS p50, " + S.pct("ttfb_ns", 0.95, "good") + " AS p95, " + S.pct("ttfb_ns", 0.99, "good") + """ AS p99,
  """ + S.mid("content_length / download_ns * 1e9", "good AND download_ns > 0") + """ AS tput FROM opf GROUP BY 1, 2),
sc AS (SELECT bucket, s3_op, http_status, count(*) AS n FROM ops WHERE http_status IS NOT NULL GROUP BY 1, 2, 3)
"""


def evidence_sql(rows: str, keys: str) -> str:
    """Evidence strings per key from a relation with keys, ts_ns, op_id, sock_cookie, aws_request_id."""
    return f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_ns, op_id) AS rn,
  CASE WHEN aws_request_id IS NOT NULL THEN row_number() OVER (PARTITION BY {keys}, aws_request_id IS NULL ORDER BY ts_ns, op_id) END AS rq FROM {rows})
  SELECT {keys}, string_agg(op_id, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS op_ids,
  array_to_string(list_sort(list_distinct(list(sock_cookie) FILTER (WHERE rn <= 5))), ',') AS sock_cookies,
  coalesce(string_agg(aws_request_id, ',' ORDER BY rq) FILTER (WHERE rq <= 5), '') AS aws_request_ids FROM r GROUP BY {keys})"""


_IDS = " ".join(f"WHEN '{c}' THEN '{fid}'" for c, (fid, _) in SC.ERROR_FINDINGS.items())
_DOM = " ".join(f"WHEN '{c}' THEN '{dom}'" for c, (_, dom) in SC.ERROR_FINDINGS.items())

ORACLES = {
    "sco1_scorecard": f"""WITH {S.OPS}, {_GROUPS}
SELECT g.bucket, g.s3_op, ops, errors, errors / ops AS error_rate,
 (SELECT string_agg(http_status || ':' || n, ',' ORDER BY http_status) FROM sc WHERE sc.bucket IS NOT DISTINCT FROM g.bucket AND sc.s3_op = g.s3_op) AS status_counts,
 CAST(round(p50) AS BIGINT) AS ttfb_p50_ns, CASE WHEN latency_sample >= 20 THEN p95 END AS ttfb_p95_ns,
 CASE WHEN latency_sample >= 100 THEN p99 END AS ttfb_p99_ns, latency_sample,
 CASE WHEN s3_op = 'GetObject' THEN tput END AS throughput_bytes_per_s, ts_start, ts_end FROM g WHERE ops > 0""",
    "sco2_reliability_findings": f"""WITH {S.OPS}, {_GROUPS},
x AS (SELECT bucket, s3_op, cls, count(*) AS n FROM opf WHERE cls <> 'success' GROUP BY 1, 2, 3),
bad AS (SELECT * FROM opf WHERE cls <> 'success'), ev AS {evidence_sql('bad', 'bucket, s3_op, cls')}
SELECT CASE x.cls {_IDS} END AS finding_id, CASE x.cls {_DOM} END AS domain, 'warn' AS severity, 'error_rate' AS metric, n / ops AS value_num,
 'ratio' AS unit, ops AS judged, group_total - ops AS excluded, 'operation' AS sample_kind, x.s3_op, x.bucket, ts_start, ts_end,
 op_ids, sock_cookies, aws_request_ids, {FLAT}
 FROM x JOIN g ON x.bucket IS NOT DISTINCT FROM g.bucket AND x.s3_op = g.s3_op
 JOIN ev ON x.bucket IS NOT DISTINCT FROM ev.bucket AND x.s3_op = ev.s3_op AND x.cls = ev.cls
 WHERE ops >= 50 AND n >= 3 AND n / ops > 0.01""",
    "sco3_heavy_tail": f"""WITH {S.OPS}, {_GROUPS},
h AS (SELECT * FROM g WHERE latency_sample >= 100 AND p50 > 0 AND p99 / p50 >= 5.0),
slow AS (SELECT o.* FROM opf o JOIN h ON o.bucket IS NOT DISTINCT FROM h.bucket AND o.s3_op = h.s3_op WHERE o.good AND o.ttfb_ns >= h.p99),
ev AS {evidence_sql('slow', 'bucket, s3_op')}
SELECT 'scorecard-latency-tail' AS finding_id, 's3' AS domain, 'advisory' AS severity, 'p99_over_p50' AS metric, p99 / p50 AS value_num,
 'ratio' AS unit, latency_sample AS judged, group_total - latency_sample AS excluded, 'operation' AS sample_kind, h.s3_op, h.bucket,
 ts_start, ts_end, op_ids, sock_cookies, aws_request_ids, {FLAT}
 FROM h JOIN ev ON h.bucket IS NOT DISTINCT FROM ev.bucket AND h.s3_op = ev.s3_op""",
    "sco4_unjudged_run": f"""WITH {S.OPS}, {S.CONNS}, {S.SAMPLES}, w AS (SELECT ts_ns FROM ops UNION ALL SELECT ts_ns FROM conns UNION ALL SELECT ts_ns FROM samples)
SELECT 'scorecard-run' AS finding_id, 'run' AS domain, 'unjudged' AS severity, 'scoreable_groups' AS metric, CAST(0 AS DOUBLE) AS value_num,
 'count' AS unit, CAST(0 AS BIGINT) AS judged, (SELECT count(*) FROM ops) AS excluded, 'operation' AS sample_kind, NULL::VARCHAR AS s3_op,
 NULL::VARCHAR AS bucket, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end, {FLAT} FROM w""",
    "agg17_capture_window": f"""WITH {S.OPS}, {S.CONNS}, {S.SAMPLES}, w AS (SELECT ts_ns FROM ops UNION ALL SELECT ts_ns FROM conns UNION ALL SELECT ts_ns FROM samples)
SELECT min(ts_ns) AS ts_start, max(ts_ns) AS ts_end FROM w""",
}

ORACLES["top5_ordered_scorecard"] = f"SELECT * FROM ({ORACLES['sco1_scorecard']}) ORDER BY bucket NULLS LAST, s3_op NULLS LAST"
