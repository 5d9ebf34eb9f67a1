from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.catalog import timeseries as TS
from tidemark.catalog.scorecard import evidence_sql
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.plans import compare as CP
from tidemark.plans import cost as CO
from tidemark.plans import findings as FD
from tidemark.plans import floors as FL
from tidemark.plans import health as H
from tidemark.plans.scorecard import capture_window
from tidemark.session import materialize
from tidemark.sources import tables as T


def _single(s, d):
    """The same connections seen on one path: no region is known."""
    return T.conns(s, d).withColumn("region", F.lit(None).cast("string"))


def _cap(s, d, builders, conns=T.conns):
    o, c, sm = T.ops(s, d), conns(s, d), T.sample_clock(s, d)
    needs = {H.NEEDS[b] for b in builders if b in H.NEEDS}
    judged = FL.judged_requests(o, c, FL.pooled_floor(c, sm)) if "tails" in needs else o
    return H.with_capture(H.op_facts(judged, needs=needs), o, c, sm)


def _rows(*builders, conns=T.conns):
    return lambda s, d: FD.flatten(H.rows(_cap(s, d, builders, conns), list(builders)))


def _classes(conns=T.conns):
    def run(s, d):
        c, sm = conns(s, d), T.sample_clock(s, d)
        return FL.judged_requests(T.ops(s, d), c, FL.pooled_floor(c, sm))

    return run


def _floors(conns=T.conns):
    def run(s, d):
        c, sm = conns(s, d), T.sample_clock(s, d)
        return FL.with_floors(T.ops(s, d), c, FL.pooled_floor(c, sm)).select("op_id", "floor_us")

    return run


def _report(conns=T.conns):
    return lambda s, d: H.report(T.ops(s, d), conns(s, d), T.sample_clock(s, d))


def _full(conns=T.conns):
    return lambda s, d: H.full_report(T.ops(s, d), conns(s, d), T.sample_clock(s, d))


def _open(s, d):
    """The connections of a capture in which none has closed: no record carries a close time before the epoch."""
    return T.conns(s, d).where("ts_ns < 0")


def _capture(conns=T.conns):
    return lambda s, d: FD.flatten(H.capture_report(T.ops(s, d), conns(s, d), T.samples(s, d, sliced=True), T.SAMPLE_TIES), with_evidence=True)


_GLOBAL = [H.floor_row, H.span_rows, H.retransmit_row, H.http_error_row]


def _medians(s, d):
    return exact_quantiles(
        T.ops(s, d),
        ["bucket", "s3_op"],
        {"ttfb": F.col("ttfb_ns"), "size": F.col("content_length")},
        [
            Stat("ttfb_mid", "ttfb", "mid"), Stat("size_upper", "size", "upper"), Stat("ttfb_p95", "ttfb", 0.95), Stat("ttfb_p99", "ttfb", 0.99),
        ],
    )


def _verdict(conns):
    def run(s, d):
        o, c = T.ops(s, d), conns(s, d)
        return H.run_verdict(H.report(o, c, T.sample_clock(s, d)), o, c)

    return run


def _baseline_ops(s, d):
    """A calmer week: half the latency, no server errors."""
    return (
        T.ops(s, d)
        .withColumn("ttfb_ns", F.expr("CASE WHEN s3_op = 'HeadObject' THEN ttfb_ns * 3 ELSE ttfb_ns div 2 END"))
        .withColumn("http_status", F.when(F.col("http_status") == 500, 200).otherwise(F.col("http_status")))
    )


def _runs(s, d):
    c, sm = _single(s, d), T.sample_clock(s, d)
    cur, base = T.ops(s, d), _baseline_ops(s, d)
    # a report is a few dozen rows: cut its lineage once, then compare the two tables
    return cur, H.report(cur, c, sm).checkpoint(), base, H.report(base, c, sm).checkpoint(), c


def _diff(s, d):
    cur, cr, _, br, _ = _runs(s, d)
    return CP.diff(cr, br, CP.populations(cr, cur))


def _gate(s, d):
    cur, cr, base, br, c = _runs(s, d)
    return CP.regression_gate(
        CP.diff(cr, br, CP.populations(cr, cur)), H.run_verdict(cr, cur, c), H.run_verdict(br, base, c)
    )


def _vanished(s, d):
    _, cr, _, br, _ = _runs(s, d)
    return CP.vanished(br, cr)


def _tagged_ops(s, d):
    tag = T.conns(s, d).select("sock_cookie", "provider", "tier")
    return T.ops(s, d).join(tag, "sock_cookie")


QUERIES = {
    "agg1_agg2_agg3_order_statistics": _medians,
    "agg4_floor_ladder": lambda s, d: FL.pooled_floor(T.conns(s, d), T.sample_clock(s, d)),
    "agg4_floor_sampled": lambda s, d: FL.pooled_floor(T.conns(s, d).withColumn("srtt_us", F.lit(0).cast("bigint")), T.sample_clock(s, d)),
    "agg4_floor_row": _rows(H.floor_row),
    "agg5_agg6_agg7_span_rows": _rows(H.span_rows, conns=_single),
    "agg6_agg7_spans_mixed_paths": _rows(H.span_rows),
    "agg8_retransmit_rate": _rows(H.retransmit_row),
    "agg9_http_errors": _rows(H.http_error_row),
    "agg10_reuse_rate": _rows(H.reuse_row),
    "agg11_class_ttfb": lambda s, d: H.class_stats(_classes()(s, d)),
    "agg11_agg12_class_rows": lambda s, d: FD.flatten(
        H.class_rows(_classes(_single)(s, d), capture_window(T.ops(s, d), T.conns(s, d), T.sample_clock(s, d)))
    ),
    "agg13_status_mix": _rows(H.status_rows),
    "agg14_get_throughput": _rows(H.throughput_row),
    "agg15_tail_rows": _rows(H.tail_rows),
    "agg16_row_populations": lambda s, d: H.op_facts(_classes()(s, d)).select(
        "total", "good", "nonpartial", "answered", "cand_dns", "cand_tcp", "cand_new", "cand_reused", "cand_tput",
        *[F.col(f"q.{n}").alias(n) for n in ("n_dns", "n_tcp", "n_new_ns", "n_reused_ns", "n_tput", "n_new_jns", "n_reused_jns")],
    ),
    "agg18_agg23_path_rows": lambda s, d: FD.flatten(
        H.path_rows(H.conn_facts(T.conns(s, d)), capture_window(T.ops(s, d), T.conns(s, d), T.sample_clock(s, d)))
    ),
    "agg25_multi_path": lambda s, d: FL.multi_path(T.conns(s, d)),
    "agg26_environment": lambda s, d: H.environment(_single(s, d), FL.pooled_floor(T.conns(s, d), T.sample_clock(s, d))).select(
        "env", "confidence", "rtt_ms", "n"
    ),
    "agg27_row_verdict": lambda s, d: H.row_verdict(H.rows(_cap(s, d, _GLOBAL), _GLOBAL)),
    "agg28_overall_verdict": _verdict(T.conns),
    "agg29_health_report": lambda s, d: FD.flatten(_full()(s, d), with_evidence=True),
    "agg29_capture_report": _capture(),
    "agg8_agg24_agg29_open_capture_report": _capture(_open),
    "agg29_health_report_one_path": lambda s, d: FD.flatten(_full(_single)(s, d), with_evidence=True),
    "agg30_evidence": lambda s, d: H.op_evidence(T.ops(s, d)).select(
        "finding_id", "row_op", *[F.array_join(F.col("evidence")[p], ",").alias(p) for p in ("op_ids", "sock_cookies", "aws_request_ids")]
    ),
    "agg31_request_cost": lambda s, d: CO.request_cost(T.ops(s, d)),
    "agg31_capture_cost": lambda s, d: CO.capture_cost(T.ops(s, d)),
    "agg32_global_rows": _rows(H.floor_row, H.span_rows, H.retransmit_row, H.http_error_row, conns=_single),
    "agg33_profile_verdict": lambda s, d: CP.profile_verdict(T.conns(s, d), "tier")
    .withColumn("tls_versions", _pairs("tls_versions"))
    .withColumn("tls_ciphers", _pairs("tls_ciphers")),
    "agg34_jn12_top1_baseline_diff": _diff,
    "agg35_regression_gate": _gate,
    "set3_vanished_checks": _vanished,
    "jn1_jn2_floor_ladder": _floors(),
    "jn2_floor_single_path": _floors(_single),
    "jn13_provider_tiers": lambda s, d: CP.provider_table(_tagged_ops(s, d), T.conns(s, d)),
    "jn13_provider_pivot": lambda s, d: CP.provider_pivot(CP.provider_table(_tagged_ops(s, d), T.conns(s, d)), ["p0", "p1"]),
}


def _pairs(c: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


# -- reference SQL ----------------------------------------------------------------------

ONE_PATH = S.CONNS.replace("lower(r_name) AS region", "NULL::VARCHAR AS region")


def floors_sql(conns: str = S.CONNS, ops: str = S.OPS) -> str:
    return f"""WITH {ops}, {conns}, {S.SAMPLES},
pool AS (SELECT {S.mid('live_srtt')} AS floor_us, count(live_srtt) AS j, count(*) - count(live_srtt) AS x, count(*) AS n,
  CAST(sum(bytes_sent) AS BIGINT) AS sent, CAST(sum(retransmits) AS BIGINT) AS rtx FROM connf),
mix AS (SELECT coalesce(min(lower(trim(region))) <> max(lower(trim(region))), false)
  OR coalesce(max(live_srtt) / min(live_srtt) >= 5 AND max(live_srtt) / 1000.0 >= 10, false) AS mixed FROM connf),
rf AS (SELECT region, {S.mid('floor_us')} AS rfl FROM connf WHERE floor_us IS NOT NULL GROUP BY 1),
uq AS (SELECT sock_cookie, any_value(floor_us) AS own, any_value(region) AS region FROM connf GROUP BY 1 HAVING count(*) = 1),
f AS (SELECT o.*, coalesce(u.own, rf.rfl, CASE WHEN NOT mixed THEN pool.floor_us END) AS fl
  FROM opf o LEFT JOIN uq u ON o.sock_cookie = u.sock_cookie LEFT JOIN rf ON u.region = rf.region, pool, mix),
win AS (SELECT min(ts_ns) AS ts_start, max(ts_ns) AS ts_end FROM (SELECT ts_ns FROM ops UNION ALL SELECT ts_ns FROM conns UNION ALL SELECT ts_ns FROM samples))
"""


_COLD = "dns_latency_ns IS NOT NULL AND NOT coalesce(dns_cache_hit, false)"
_MEAS = "s3_op = 'GetObject' AND download_ns > 0 AND content_length IS NOT NULL"


def facts_sql() -> str:
    parts = [
        "count(*) AS total", "count(*) FILTER (WHERE good) AS good_n", "count(*) FILTER (WHERE NOT partial) AS nonpartial",
        "count(*) FILTER (WHERE NOT partial AND connection_reused) AS np_reused", "count(http_status) AS answered",
        "count(*) FILTER (WHERE http_status >= 400) AS errors", "count(*) FILTER (WHERE cls = 'throttle') AS throttle",
        "count(*) FILTER (WHERE cls = 'server') AS server",
        "count(*) FILTER (WHERE cls IN ('forbidden', 'not_found', 'bad_request', 'client')) AS client",
        f"count(*) FILTER (WHERE {_COLD}) AS cand_dns", "count(tcp_connect_ns) AS cand_tcp",
        f"count(*) FILTER (WHERE {_MEAS}) AS cand_tput",
        f"{S.mid('dns_latency_ns', 'good AND ' + _COLD)} AS dns", f"count(*) FILTER (WHERE good AND {_COLD}) AS n_dns",
        f"{S.mid('tcp_connect_ns', 'good')} AS tcp", "count(tcp_connect_ns) FILTER (WHERE good) AS n_tcp",
        f"{S.mid('content_length / download_ns * 1e3', 'good AND ' + _MEAS)} AS tput", f"count(*) FILTER (WHERE good AND {_MEAS}) AS n_tput",
    ]
    for side, on in (("new", "NOT connection_reused"), ("reused", "connection_reused")):
        j = f"good AND {on} AND fl IS NOT NULL"
        parts += [
            f"count(ttfb_ns) FILTER (WHERE {on}) AS cand_{side}", f"count(ttfb_ns) FILTER (WHERE good AND {on}) AS n_{side}",
            f"count(ttfb_ns) FILTER (WHERE {j}) AS j_{side}", f"{S.mid('ttfb_ns', 'good AND ' + on)} AS mid_{side}",
            f"min(fl / 1e3 * 1e3) FILTER (WHERE {j} AND ttfb_ns IS NOT NULL) AS lo_{side}", f"max(fl / 1e3 * 1e3) FILTER (WHERE {j} AND ttfb_ns IS NOT NULL) AS hi_{side}",
        ]
        for p in (95, 99):
            parts += [
                f"{S.pct('(ttfb_ns / 1e6)', p / 100, 'good AND ' + on)} AS a{p}_{side}",
                f"{S.pct('(ttfb_ns / 1e6)', p / 100, j)} AS v{p}_{side}",
                f"{S.pct('(ttfb_ns / 1e6 / (fl / 1e3))', p / 100, j)} AS r{p}_{side}",
            ]
    return "fx AS (SELECT " + ", ".join(parts) + """ FROM f),
fc AS (SELECT fx.*, pool.floor_us AS pool_us, pool.j AS pool_j, pool.x AS pool_x, pool.n AS conn_n, sent, rtx, mixed,
  CASE WHEN NOT mixed THEN pool.floor_us / 1000.0 END AS rtt, CAST(trunc(pool.floor_us) AS BIGINT) AS base, ts_start, ts_end FROM fx, pool, mix, win)
"""


def row_sql(fid, sev, verdict, metric, value, unit, judged, excluded, *, baseline="NULL", ratio="NULL", domain="network", kind="operation",
            op="NULL", text="NULL", src="fc", where="true"):
    return f"""SELECT '{fid}' AS finding_id, '{domain}' AS domain, {sev} AS severity, {verdict} AS verdict, {metric} AS metric,
 CAST({value} AS DOUBLE) AS value_num, CAST({text} AS VARCHAR) AS value_str, '{unit}' AS unit, CAST({baseline} AS BIGINT) AS baseline_rtt_us,
 CAST({ratio} AS DOUBLE) AS ratio_to_rtt, CAST({judged} AS BIGINT) AS judged, CAST({excluded} AS BIGINT) AS excluded, '{kind}' AS sample_kind,
 CAST({op} AS VARCHAR) AS s3_op, NULL::VARCHAR AS bucket, NULL::VARCHAR AS prefix_hash, NULL::VARCHAR AS region, NULL::BIGINT AS app_pid,
 ts_start, ts_end FROM {src} WHERE {where}"""


def _span(fid, stat, n, cand, mult, word):
    r = f"{stat} / 1e6 / rtt"
    return row_sql(
        fid, f"CASE WHEN rtt IS NULL THEN 'unjudged' WHEN {r} <= {mult} THEN 'healthy' ELSE 'warn' END",
        f"CASE WHEN rtt IS NULL THEN 'n/a' WHEN {r} <= {mult} THEN '{word}' ELSE 'high' END", f"'{fid}'", f"{stat} / 1e6", "ms", n, f"{cand} - {n}",
        baseline="CASE WHEN rtt IS NOT NULL THEN base END", ratio=r, where=f"{stat} IS NOT NULL",
    )


R_FLOOR = [row_sql("baseline_rtt", "'unjudged'", "'floor'", "'baseline_rtt'", "pool_us / 1000.0", "ms", "pool_j", "pool_x", baseline="base", kind="connection", where="pool_us IS NOT NULL")]
R_SPANS = [
    row_sql("dns_cold", "'unjudged'", "'fyi'", "'dns_cold'", "dns / 1e6", "ms", "n_dns", "cand_dns - n_dns", where="dns IS NOT NULL"),
    _span("tcp_connect", "tcp", "n_tcp", "cand_tcp", 3.0, "expected"),
    _span("ttfb_new", "mid_new", "n_new", "cand_new", 4.0, "expected"),
    _span("ttfb_reused", "mid_reused", "n_reused", "cand_reused", 4.0, "good"),
]
_SEG = "(sent // 1460)"
R_RTX = [row_sql("retransmit_rate", f"CASE WHEN {_SEG} < 44 THEN 'unjudged' WHEN rtx / {_SEG} <= 0.001 THEN 'healthy' ELSE 'warn' END",
                 f"CASE WHEN {_SEG} < 44 THEN 'n/a' WHEN rtx / {_SEG} <= 0.001 THEN 'clean' ELSE 'loss' END", "'retransmit_rate'",
                 f"CASE WHEN {_SEG} >= 44 THEN rtx / {_SEG} END", "ratio", "conn_n", "0", kind="connection")]
R_ERR = [row_sql("http_errors", "CASE WHEN answered = 0 THEN 'unjudged' WHEN errors = 0 THEN 'healthy' ELSE 'warn' END",
                 "CASE WHEN answered = 0 THEN 'n/a' WHEN errors = 0 THEN 'healthy' ELSE 'errors' END", "'http_errors'",
                 "CASE WHEN answered > 0 THEN errors END", "count", "answered", "total - answered", domain="client")]
R_REUSE = [row_sql("reuse_rate", "CASE WHEN np_reused / nonpartial >= 0.8 THEN 'healthy' ELSE 'warn' END",
                   "CASE WHEN np_reused / nonpartial >= 0.8 THEN 'good' ELSE 'low' END", "'reuse_rate'", "np_reused / nonpartial", "ratio",
                   "nonpartial", "total - nonpartial", domain="client", where="nonpartial >= 5")]
R_STATUS = [
    row_sql(fid, "'warn'", f"'{v}'", f"'{m}'", c, "count", "answered", "total - answered", domain="s3", where=f"{c} > 0")
    for fid, c, v, m in (
        ("s3_throttle", "throttle", "throttle", "s3_status_throttle"), ("s3_server_errors", "server", "retryable", "s3_status_server"),
        ("s3_client_errors", "client", "client", "s3_status_client"),
    )
]
R_TPUT = [row_sql("s3_throughput", "'advisory'", "'fyi'", "'s3_get_throughput'", "tput * 1e6", "bytes_per_s", "n_tput", "cand_tput - n_tput", domain="s3", op="'GetObject'", where="tput IS NOT NULL")]


def _tail(side, p, least, mult):
    few, blind = f"j_{side} < {least}", f"(r{p}_{side} <= {mult} AND (n_{side} - j_{side}) / n_{side} > 1.0 - {p} / 100.0)"
    na = f"({few} OR coalesce({blind}, false))"
    return row_sql(
        f"ttfb_{side}_p{p}", f"CASE WHEN {na} THEN 'unjudged' WHEN r{p}_{side} <= {mult} THEN 'healthy' ELSE 'warn' END",
        f"CASE WHEN {na} THEN 'n/a' WHEN r{p}_{side} <= {mult} THEN 'expected' ELSE 'high' END", f"'ttfb_{side}_p{p}'",
        f"CASE WHEN {na} THEN a{p}_{side} ELSE v{p}_{side} END", "ms", f"CASE WHEN {few} THEN 0 ELSE j_{side} END",
        f"CASE WHEN {few} THEN n_{side} ELSE n_{side} - j_{side} END",
        baseline=f"CASE WHEN NOT {na} AND lo_{side} = hi_{side} THEN round(lo_{side}) END", ratio=f"CASE WHEN NOT {na} THEN r{p}_{side} END",
        where=f"n_{side} >= {least}",
    )


R_TAIL = [_tail(s, p, n, m) for s in ("new", "reused") for p, n, m in ((95, 20, 8.0), (99, 100, 12.0))]
CLASSES = f"""cl AS (SELECT s3_op, {S.mid('(ttfb_ns / 1e6)', 'good')} AS ttfb_all_ms, {S.mid('(ttfb_ns / 1e6)', 'good AND fl IS NOT NULL')} AS ttfb_ms,
 {S.mid('(ttfb_ns / 1e6 / (fl / 1e3))', 'good AND fl IS NOT NULL')} AS ratio,
 {S.mid('greatest(ttfb_ns / 1e6 - fl / 1e3, 0.0)', 'good AND fl IS NOT NULL')} AS think_ms,
 count(ttfb_ns) FILTER (WHERE good) AS timed, count(ttfb_ns) FILTER (WHERE good AND fl IS NOT NULL) AS judged, count(ttfb_ns) AS candidates,
 min(fl / 1e3 * 1e3) FILTER (WHERE good AND ttfb_ns IS NOT NULL) AS floor_lo, max(fl / 1e3 * 1e3) FILTER (WHERE good AND ttfb_ns IS NOT NULL) AS floor_hi
 FROM f WHERE s3_op IS NOT NULL GROUP BY 1)"""
_CNA = "(ratio IS NULL OR (ratio <= 4.0 AND judged < 3))"
R_CLASS = [row_sql("s3_ttfb", f"CASE WHEN {_CNA} THEN 'unjudged' WHEN ratio <= 4.0 THEN 'healthy' ELSE 'warn' END",
                   f"CASE WHEN {_CNA} THEN 'n/a' WHEN ratio <= 4.0 THEN 'expected' ELSE 'high' END", "'s3_ttfb'",
                   "CASE WHEN judged > 0 THEN ttfb_ms ELSE ttfb_all_ms END", "ms", "judged", "greatest(candidates - judged, 0)", domain="s3",
                   op="s3_op", ratio=f"CASE WHEN NOT {_CNA} THEN ratio END",
                   baseline=f"CASE WHEN NOT {_CNA} AND floor_lo = floor_hi THEN round(floor_lo) END", src="(SELECT * FROM cl, win)", where="timed > 0")]

_PATH_M = {
    "m_min": ("live_min / 1e3", "true"), "m_tls": ("tls_handshake_ns / 1e6", "true"), "m_infl": ("live_srtt / live_min", "true"),
    "m_bdp": ("ceil_out", "true"), "m_bdp_j": ("ceil_out", "rate IS NOT NULL"), "m_rate": ("rate", "true"), "m_rcv": ("ceil_in", "true"), "m_rcv_rate": ("rate_in", "true"),
}
PATH = f"""pc AS (SELECT *, CASE WHEN send_heavy AND snd_cwnd > 0 AND mss > 0 THEN snd_cwnd * mss / (live_min / 1e6) END AS ceil_out,
 CASE WHEN recv_heavy AND lifetime_ns > 0 AND window_clamp > 0 THEN window_clamp / (live_min / 1e6) END AS ceil_in FROM connf),
pd AS (SELECT *, CASE WHEN ceil_out IS NOT NULL AND delivery_rate_bps > 0 THEN CAST(delivery_rate_bps AS DOUBLE) END AS rate,
 CASE WHEN ceil_in IS NOT NULL THEN bytes_recv / (lifetime_ns / 1e9) END AS rate_in FROM pc),
pf AS (SELECT count(*) AS n, {', '.join(f'{S.mid("(" + x + ")", c)} AS {k}' for k, (x, c) in _PATH_M.items())},
 coalesce(sum(busy_jiffies) FILTER (WHERE send_heavy), 0) AS busy, coalesce(sum(rwnd_limited_jiffies) FILTER (WHERE send_heavy), 0) AS rwnd,
 coalesce(sum(sndbuf_limited_jiffies) FILTER (WHERE send_heavy), 0) AS sndbuf,
 count(*) FILTER (WHERE rate IS NOT NULL AND coalesce(app_limited, false) AND rate < 0.5 * ceil_out) AS app_lim,
 max(reordering) AS reord, count(*) FILTER (WHERE ca_state >= 3) AS recov, coalesce(sum(rcv_ooopack), 0) AS ooo,
 coalesce(sum(dsack_dups) FILTER (WHERE send_heavy), 0) AS dsack,
 arg_min(tls_version, ts_ns) FILTER (WHERE tls_version IS NOT NULL) AS ver, arg_min(tls_cipher, ts_ns) FILTER (WHERE tls_cipher IS NOT NULL) AS cip FROM pd)"""
_PSRC = "(SELECT * FROM pf, win)"
R_PATH = [
    row_sql("path_min_rtt", "'unjudged'", "'fyi'", "'min_rtt'", "m_min", "ms", "n", "0", kind="connection", src=_PSRC, where="m_min IS NOT NULL",
            text="CASE WHEN m_infl >= 2.0 THEN 'inflated' WHEN m_infl IS NOT NULL THEN 'stable' ELSE 'not judged' END"),
    row_sql("tls_handshake", "'unjudged'", "'fyi'", "'tls_handshake'", "m_tls", "ms", "n", "0", kind="connection", src=_PSRC, where="m_tls IS NOT NULL",
            ratio="m_tls / m_min", baseline="round(m_min * 1e3)", text="ver || '/' || cip"),
    row_sql("send_bottleneck", "'unjudged'", "'fyi'", "'send_free_pct'", "busy / (busy + rwnd + sndbuf) * 100.0", "none", "n", "0", kind="connection", domain="client", src=_PSRC, where="busy + rwnd + sndbuf > 0"),
    row_sql("bdp_ceiling", "'unjudged'", "'fyi'", "'bdp_ceiling'", "m_bdp", "bytes_per_s", "n", "0", kind="connection", domain="client", src=_PSRC, where="m_bdp IS NOT NULL",
            text="CASE WHEN m_rate < 0.5 * m_bdp_j AND app_lim > 0 THEN 'app-limited' WHEN m_rate < 0.5 * m_bdp_j THEN 'under-ceiling' WHEN m_rate IS NOT NULL THEN 'near-ceiling' END"),
    row_sql("recv_ceiling", "'unjudged'", "'fyi'", "'recv_window_ceiling'", "m_rcv", "bytes_per_s", "n", "0", kind="connection", domain="client", src=_PSRC, where="m_rcv IS NOT NULL",
            text="CASE WHEN coalesce(m_rcv_rate, 0) / m_rcv >= 0.7 THEN 'receive-window-limited' ELSE 'under-ceiling' END"),
    row_sql("loss_shape", "'unjudged'", "'fyi'", "CASE WHEN reord > 3 THEN 'reordering' WHEN recov > 0 THEN 'loss_recovery' WHEN ooo > 0 THEN 'rcv_ooopack' ELSE 'dsack_dups' END",
            "CASE WHEN reord > 3 THEN reord WHEN recov > 0 THEN recov WHEN ooo > 0 THEN ooo ELSE dsack END", "count", "n", "0", kind="connection", src=_PSRC,
            where="reord > 3 OR recov > 0 OR ooo > 0 OR dsack > 0"),
]
ENV = """env AS (SELECT *, CASE WHEN many THEN 'mixed' WHEN n > 0 AND cross_n = n THEN 'cross-region' WHEN bim THEN 'mixed' WHEN cross_n > 0 THEN 'cross-region'
 WHEN rtt_ms < 10 THEN 'same-region' WHEN rtt_ms IS NOT NULL THEN 'wan-or-cross-region' END AS cls FROM
 (SELECT count(*) AS n, count(*) FILTER (WHERE cross_region) AS cross_n, count(*) FILTER (WHERE via_vpce) AS vp, coalesce(min(region) <> max(region), false) AS many,
  coalesce(max(live_srtt) / min(live_srtt) >= 5 AND max(live_srtt) / 1000.0 >= 10, false) AS bim, (SELECT floor_us FROM pool) / 1000.0 AS rtt_ms FROM connf))"""
R_ENV = [row_sql("environment", "'unjudged'", "cls", "'environment'", "NULL", "none", "n", "0", kind="connection", text="cls",
                 baseline="trunc(rtt_ms * 1000.0)", src="(SELECT * FROM env, win)", where="cls IS NOT NULL")]
R_OPS = R_FLOOR + R_SPANS + R_RTX + R_ERR + R_TAIL + R_REUSE + R_STATUS + R_TPUT


def report_sql(conns: str = S.CONNS, ops: str = S.OPS) -> str:
    return f"{floors_sql(conns, ops)}, {facts_sql()}, {CLASSES}, {PATH}, {ENV} " + " UNION ALL ".join(R_OPS + R_CLASS + R_PATH + R_ENV)


def _rows_sql(rows: list[str], conns: str = S.CONNS) -> str:
    return f"{floors_sql(conns)}, {facts_sql()} " + " UNION ALL ".join(rows)


_BASE_OPS = S.OPS.replace(
    "opf AS (SELECT *,",
    """ops2 AS (SELECT * REPLACE (CASE WHEN s3_op = 'HeadObject' THEN ttfb_ns * 3 ELSE ttfb_ns // 2 END AS ttfb_ns,
 CASE WHEN http_status = 500 THEN 200 ELSE http_status END AS http_status) FROM ops),
opf AS (SELECT *,""",
).replace(" FROM ops)\n", " FROM ops2)\n")
_VERDICT = """v AS (SELECT CASE WHEN bool_or(severity = 'warn') THEN 'ATTENTION' WHEN (SELECT count(*) FROM ops) = 0 THEN 'NO OPERATIONS'
 WHEN (SELECT count(http_status) FROM ops) = 0 THEN 'NO RESPONSES' WHEN (SELECT mixed FROM mix) AND NOT bool_or(ratio_to_rtt IS NOT NULL AND finding_id <> 'tls_handshake') THEN 'MIXED PATHS'
 WHEN NOT bool_or(finding_id = 'baseline_rtt') THEN 'NO BASELINE' WHEN NOT bool_or(finding_id IN ('tcp_connect', 'ttfb_new', 'ttfb_reused')) THEN 'CHECKS PASSED' ELSE 'HEALTHY' END AS verdict,
 bool_or(severity = 'advisory') AS adv, bool_or(finding_id = 'ttfb_reused') AS reu FROM rep)"""
_DELTAS = f"""cur AS ({report_sql(ONE_PATH)}), bas AS ({report_sql(ONE_PATH, _BASE_OPS)}),
c AS (SELECT *, coalesce(s3_op, '') AS k, coalesce(ratio_to_rtt, value_num) AS v, CASE WHEN finding_id IN ('http_errors', 's3_throttle', 's3_server_errors', 's3_client_errors')
  THEN coalesce(ratio_to_rtt, value_num) / nullif(judged, 0) ELSE coalesce(ratio_to_rtt, value_num) END AS g FROM cur),
b AS (SELECT *, coalesce(s3_op, '') AS k, coalesce(ratio_to_rtt, value_num) AS v, CASE WHEN finding_id IN ('http_errors', 's3_throttle', 's3_server_errors', 's3_client_errors')
  THEN coalesce(ratio_to_rtt, value_num) / nullif(judged, 0) ELSE coalesce(ratio_to_rtt, value_num) END AS g FROM bas WHERE severity <> 'unjudged'),
j AS (SELECT c.finding_id AS cid, b.finding_id AS bid, coalesce(c.finding_id, b.finding_id) AS finding_id, coalesce(c.k, b.k) AS s3_op, c.severity AS csev, b.severity AS bsev,
  c.unit AS cu, b.unit AS bu, c.metric AS cm, c.judged AS cn, b.judged AS bn, c.v AS cv, b.v AS bv, c.g AS cg, b.g AS bg, c.ratio_to_rtt IS NOT NULL AS rel,
  CASE WHEN c.finding_id IN ('http_errors', 's3_throttle', 's3_server_errors', 's3_client_errors') THEN 1.0 / greatest(c.judged, 1) WHEN c.ratio_to_rtt IS NOT NULL THEN 0.5
  WHEN c.unit = 'count' THEN 1.0 WHEN c.unit = 'ratio' THEN 0.001 WHEN c.unit = 'ms' THEN 5.0 ELSE 0.0 END AS least,
  c.unit = 'bytes_per_s' OR c.metric = 'reuse_rate' AS hb FROM c FULL JOIN b ON c.finding_id = b.finding_id AND c.k = b.k),
pops AS (SELECT count(http_status) AS answered, count(*) FILTER (WHERE NOT partial) AS nonpartial, count(*) FILTER (WHERE good) AS good FROM opf0),
kinds AS (SELECT j.*, CASE WHEN cid IS NOT NULL AND bid IS NOT NULL AND csev = 'unjudged' THEN CASE WHEN bsev = 'warn' THEN 'unjudgeable' ELSE 'unchanged' END
  WHEN cid IS NOT NULL AND bid IS NOT NULL THEN CASE WHEN bg IS NULL THEN 'unchanged' WHEN cg IS NULL THEN 'unjudgeable'
    WHEN hb THEN CASE WHEN cg < bg * 0.75 THEN 'regressed' WHEN cg > bg * 1.25 THEN 'improved' ELSE 'unchanged' END
    WHEN cg > bg * 1.25 AND cg - bg >= least THEN 'regressed' WHEN cg < bg * 0.75 AND bg - cg >= least THEN 'improved' ELSE 'unchanged' END
  WHEN cid IS NOT NULL AND csev = 'warn' THEN 'new_issue'
  WHEN cid IS NULL AND bsev = 'warn' THEN CASE WHEN CASE WHEN bid IN ('http_errors', 's3_throttle', 's3_server_errors', 's3_client_errors') THEN answered
     WHEN bid = 'reuse_rate' THEN nonpartial WHEN bid = 's3_ttfb' OR bid IN ('dns_cold', 'tcp_connect') OR bid LIKE 'ttfb%' THEN 0 ELSE good END >= bn THEN 'resolved' ELSE 'unjudgeable' END
  END AS kind FROM j, pops),
deltas AS (SELECT finding_id, s3_op, kind, bv AS baseline, CASE WHEN NOT (cid IS NULL OR csev = 'unjudged' OR (bid IS NOT NULL AND bg IS NOT NULL AND cg IS NULL)) THEN cv END AS current,
  CASE WHEN cid IS NOT NULL AND bid IS NOT NULL AND csev <> 'unjudged' THEN csev WHEN bid IS NULL THEN csev ELSE bsev END AS severity, coalesce(cu, bu) AS unit,
  CASE kind WHEN 'new_issue' THEN 0 WHEN 'regressed' THEN 1 WHEN 'unjudgeable' THEN 2 WHEN 'improved' THEN 3 WHEN 'resolved' THEN 4 ELSE 5 END AS kind_rank FROM kinds WHERE kind IS NOT NULL)"""
_OPF0 = S.OPS.replace("e AS (", "e0 AS (").replace("FROM e)", "FROM e0)").replace("ops AS (", "ops0 AS (").replace(" FROM ops)", " FROM ops0)").replace("opf AS (", "opf0 AS (")

ORACLES = {
    "agg1_agg2_agg3_order_statistics": f"""WITH {S.OPS} SELECT bucket, s3_op, {S.mid('ttfb_ns')} AS ttfb_mid, CAST({S.upper('content_length')} AS DOUBLE) AS size_upper,
 CAST({S.pct('ttfb_ns', 0.95)} AS DOUBLE) AS ttfb_p95, CAST({S.pct('ttfb_ns', 0.99)} AS DOUBLE) AS ttfb_p99, count(ttfb_ns) AS n_ttfb, count(content_length) AS n_size FROM ops GROUP BY 1, 2""",
    "agg4_floor_ladder": f"{floors_sql()} SELECT floor_us, 'srtt' AS source, j AS judged, x AS excluded FROM pool",
    "agg4_floor_sampled": f"""WITH {S.SAMPLES} SELECT {S.mid('min_rtt_us')} AS floor_us, 'min_rtt (sampled)' AS source, count(min_rtt_us) AS judged,
 count(*) - count(min_rtt_us) AS excluded FROM samples""",
    "agg4_floor_row": _rows_sql(R_FLOOR),
    "agg5_agg6_agg7_span_rows": _rows_sql(R_SPANS, ONE_PATH),
    "agg6_agg7_spans_mixed_paths": _rows_sql(R_SPANS),
    "agg8_retransmit_rate": _rows_sql(R_RTX),
    "agg9_http_errors": _rows_sql(R_ERR),
    "agg10_reuse_rate": _rows_sql(R_REUSE),
    "agg11_class_ttfb": f"""{floors_sql()}, {CLASSES.replace('GROUP BY 1)', 'GROUP BY 1)')}
 SELECT *, judged AS n_ratio, judged AS n_think FROM cl""",
    "agg11_agg12_class_rows": f"{floors_sql(ONE_PATH)}, {CLASSES} " + R_CLASS[0],
    "agg13_status_mix": _rows_sql(R_STATUS),
    "agg14_get_throughput": _rows_sql(R_TPUT),
    "agg15_tail_rows": _rows_sql(R_TAIL),
    "agg16_row_populations": f"""{floors_sql()}, {facts_sql()} SELECT total, good_n AS good, nonpartial, answered, cand_dns, cand_tcp, cand_new, cand_reused, cand_tput,
 n_dns, n_tcp, n_new AS n_new_ns, n_reused AS n_reused_ns, n_tput, j_new AS n_new_jns, j_reused AS n_reused_jns FROM fc""",
    "agg18_agg23_path_rows": f"{floors_sql()}, {PATH} " + " UNION ALL ".join(R_PATH),
    "agg25_multi_path": f"{floors_sql()} SELECT mixed FROM mix",
    "agg26_environment": f"""{floors_sql(ONE_PATH)}, {ENV} SELECT cls AS env, CASE WHEN cls IN ('mixed', 'cross-region') THEN 'high'
 WHEN rtt_ms < 2 OR (rtt_ms < 10 AND vp > 0) THEN 'high' WHEN rtt_ms < 10 THEN 'likely' ELSE 'uncertain' END AS confidence, rtt_ms, n FROM env""",
    "agg27_row_verdict": f"{floors_sql()}, {facts_sql()} SELECT CASE WHEN bool_or(severity = 'warn') THEN 'ATTENTION' ELSE 'HEALTHY' END AS verdict, NULL::BOOLEAN AS reuse_working FROM ("
    + " UNION ALL ".join(R_FLOOR + R_SPANS + R_RTX + R_ERR) + ")",
    "agg28_overall_verdict": f"""{floors_sql()}, {facts_sql()}, {CLASSES}, {PATH}, {ENV}, rep AS ({' UNION ALL '.join(R_OPS + R_CLASS + R_PATH + R_ENV)}), {_VERDICT}
 SELECT verdict, 'warn' AS severity, NULL::BOOLEAN AS reuse_working, (SELECT count(*) FROM ops) AS operations, (SELECT count(http_status) FROM ops) AS answered,
 CASE WHEN verdict = 'ATTENTION' THEN 1 ELSE 2 END AS exit_code, CASE WHEN verdict = 'ATTENTION' THEN 1 ELSE 2 END AS exit_code_strict FROM v""",
    "agg30_evidence": f"""WITH {S.OPS}, t AS (SELECT *, 'http_errors' AS finding_id, NULL::VARCHAR AS row_op FROM opf WHERE http_status >= 400
 UNION ALL SELECT *, 's3_throttle', NULL FROM opf WHERE cls = 'throttle' UNION ALL SELECT *, 's3_server_errors', NULL FROM opf WHERE cls = 'server'
 UNION ALL SELECT *, 's3_client_errors', NULL FROM opf WHERE cls IN ('forbidden', 'not_found', 'bad_request', 'client')
 UNION ALL SELECT *, 's3_ttfb', s3_op FROM opf WHERE good), ev AS {evidence_sql('t', 'finding_id, row_op')} SELECT * FROM ev""",
    "agg31_request_cost": f"""WITH {S.OPS}, a AS (SELECT s3_op, count(*) AS count, CASE WHEN regexp_matches(s3_op, '^(Delete|Abort)') THEN 'free'
 WHEN regexp_matches(s3_op, '^(Put|Post|Copy|List|Create|Upload|Complete)') THEN 'tier-1' ELSE 'tier-2' END AS tier FROM ops GROUP BY 1)
 SELECT s3_op, count, tier, count / 1000.0 * CAST(CASE tier WHEN 'free' THEN 0 WHEN 'tier-1' THEN 0.005 ELSE 0.0004 END AS DOUBLE) AS usd FROM a""",
    "agg31_capture_cost": f"""WITH {S.OPS} SELECT count(*) AS operations, count(*) FILTER (WHERE http_status >= 400) AS error_requests,
 count(*) FILTER (WHERE http_status BETWEEN 200 AND 299 AND verb = 'GET' AND download_ns IS NULL AND content_length IS NOT NULL) AS unmeasured_gets,
 sum(CASE WHEN regexp_matches(s3_op, '^(Put|List)') THEN 0.005::DOUBLE ELSE 0.0004::DOUBLE END / 1000.0) AS request_usd,
 coalesce(sum(content_length) FILTER (WHERE http_status BETWEEN 200 AND 299 AND verb = 'GET' AND download_ns IS NOT NULL), 0) / 1073741824.0::DOUBLE AS gib_returned FROM ops""",
    "agg32_global_rows": _rows_sql(R_FLOOR + R_SPANS + R_RTX + R_ERR, ONE_PATH),
    "agg33_profile_verdict": f"""WITH {S.CONNS}, p AS (SELECT *, CASE WHEN srtt_us > 0 AND min_rtt_us > 0 THEN srtt_us / min_rtt_us END AS inf,
 CASE tls_cipher WHEN 4865 THEN 'TLS_AES_128_GCM_SHA256' WHEN 4866 THEN 'TLS_AES_256_GCM_SHA384' WHEN 4867 THEN 'TLS_CHACHA20_POLY1305_SHA256' END AS cn FROM connf),
 tv AS (SELECT tier, string_agg(tls_version || ':' || n, ',' ORDER BY tls_version) AS t FROM (SELECT tier, tls_version, count(*) AS n FROM p WHERE tls_version IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 tc AS (SELECT tier, string_agg(cn || ':' || n, ',' ORDER BY cn) AS t FROM (SELECT tier, cn, count(*) AS n FROM p WHERE cn IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 a AS (SELECT tier, count(*) AS conns, {S.mid('(min_rtt_us / 1e3)', 'min_rtt_us > 0')} AS min_rtt_ms, {S.mid('(rttvar_us / 1e3)', 'rttvar_us > 0')} AS jitter_ms,
 {S.mid('(srtt_us / 1e3)', 'srtt_us > 0')} AS srtt_ms, {S.mid('inf')} AS inflation, CAST(sum(retransmits) AS BIGINT) AS retransmits,
 count(*) FILTER (WHERE retransmits > 0) AS lossy_conns, CAST(coalesce(sum(rcv_ooopack), 0) AS BIGINT) AS out_of_order, CAST(sum(bytes_retrans) AS BIGINT) AS bytes_retrans,
 sum(bytes_retrans) * 100.0::DOUBLE / sum(bytes_sent) AS retrans_pct, CAST(coalesce(sum(dsack_dups) FILTER (WHERE send_heavy), 0) AS BIGINT) AS dsack,
 count(*) FILTER (WHERE send_heavy AND app_limited) AS app_limited, coalesce(max(reordering), 0) AS max_reordering FROM p GROUP BY 1)
 SELECT a.*, tv.t AS tls_versions, tc.t AS tls_ciphers, CASE WHEN inflation >= 2 AND NOT lossy_conns * 5 > conns THEN 'bufferbloat' WHEN inflation >= 2 THEN 'congestion+loss' ELSE 'stable' END AS verdict
 FROM a JOIN tv ON a.tier = tv.tier JOIN tc ON a.tier = tc.tier""",
    "agg34_jn12_top1_baseline_diff": f"WITH {_OPF0}, {_DELTAS} SELECT * FROM deltas",
    "agg35_regression_gate": f"""WITH {_OPF0}, {_DELTAS} SELECT count(*) AS deltas, 'ATTENTION' AS baseline_verdict, 'ATTENTION' AS current_verdict,
 bool_or(kind IN ('new_issue', 'unjudgeable') OR (kind = 'regressed' AND severity <> 'advisory')) AS regressed, bool_or(kind IN ('new_issue', 'unjudgeable', 'regressed')) AS regressed_strict,
 false AS dissimilar FROM deltas""",
    "set3_vanished_checks": f"""WITH cur AS ({report_sql(ONE_PATH)}), bas AS ({report_sql(ONE_PATH, _BASE_OPS)})
 SELECT finding_id, coalesce(s3_op, '') AS s3_op, severity, judged FROM cur WHERE severity = 'warn'
 AND NOT EXISTS (SELECT 1 FROM bas WHERE bas.finding_id = cur.finding_id AND coalesce(bas.s3_op, '') = coalesce(cur.s3_op, ''))""",
    "jn1_jn2_floor_ladder": f"{floors_sql()} SELECT op_id, fl AS floor_us FROM f",
    "jn2_floor_single_path": f"{floors_sql(ONE_PATH)} SELECT op_id, fl AS floor_us FROM f",
    "jn13_provider_tiers": f"""WITH {S.OPS}, {S.CONNS}, n AS (SELECT tier, provider, {S.mid('(srtt_us / 1e3)', 'srtt_us > 0')} AS srtt_ms FROM conns GROUP BY 1, 2),
 o AS (SELECT c.tier, c.provider, {S.upper('(ttfb_ns / 1e6)', 'ttfb_ns > 0 AND NOT partial')} AS ttfb_p50_ms,
 {S.mid('(content_length / download_ns * 1e3)', 'download_ns > 0 AND content_length > 0')} AS mb_per_s FROM ops JOIN conns c USING (sock_cookie) GROUP BY 1, 2)
 SELECT coalesce(n.tier, o.tier) AS tier, coalesce(n.provider, o.provider) AS provider, coalesce(srtt_ms, 0.0::DOUBLE) AS srtt_ms, coalesce(ttfb_p50_ms, 0.0::DOUBLE) AS ttfb_p50_ms, mb_per_s,
 coalesce(ttfb_p50_ms, 0.0::DOUBLE) - coalesce(srtt_ms, 0.0::DOUBLE) AS think_ms FROM n FULL JOIN o ON n.tier = o.tier AND n.provider = o.provider""",
}
ORACLES["jn13_provider_pivot"] = f"""WITH t AS ({ORACLES['jn13_provider_tiers']}) SELECT tier, max(think_ms) FILTER (WHERE provider = 'p0') AS p0_think_ms,
 max(mb_per_s) FILTER (WHERE provider = 'p0') AS p0_mb_per_s, max(think_ms) FILTER (WHERE provider = 'p1') AS p1_think_ms, max(mb_per_s) FILTER (WHERE provider = 'p1') AS p1_mb_per_s FROM t GROUP BY 1"""


def full_report_sql(conns: str = S.CONNS, floors: str | None = None, more: str = "") -> str:
    rep = " UNION ALL ".join(R_OPS + R_CLASS + R_PATH + R_ENV)
    base = f"{floors or floors_sql(conns)}, {facts_sql()}, {CLASSES}, {PATH}, {ENV}, rep AS (({rep}){more})"
    run = f"""{base}, {_VERDICT} SELECT verdict, CASE WHEN verdict = 'ATTENTION' THEN 'warn' WHEN verdict IN ('HEALTHY', 'CHECKS PASSED') THEN 'healthy' ELSE 'unjudged' END AS severity,
 (SELECT count(http_status) FROM ops) + (SELECT count(*) FROM conns) AS judged, (SELECT count(*) - count(http_status) FROM ops) AS excluded,
 (SELECT CAST(max(round(value_num * 1000)) AS BIGINT) FROM rep WHERE finding_id = 'baseline_rtt') AS baseline_rtt_us, (SELECT max(ts_start) FROM rep) AS ts_start, (SELECT max(ts_end) FROM rep) AS ts_end FROM v"""
    return f"""SELECT r.*, op_ids, sock_cookies, aws_request_ids FROM ({base} SELECT * FROM rep) r LEFT JOIN ({ORACLES['agg30_evidence']}) e
 ON r.finding_id = e.finding_id AND r.s3_op IS NOT DISTINCT FROM e.row_op
UNION ALL BY NAME SELECT 'run' AS finding_id, 'run' AS domain, 'verdict' AS metric, 'none' AS unit, 'mixed' AS sample_kind, * FROM ({run})"""


ORACLES["agg29_health_report"] = full_report_sql()
ORACLES["agg29_health_report_one_path"] = full_report_sql(ONE_PATH)

# the rows about samples stand on the chain of CTEs about segments, and on the window of the whole capture
_CHAIN, _SERIES = TS.ORACLES["ts_series_rows"].removeprefix("WITH ").split("\nSELECT", 1)
_SERIES = _SERIES.replace("(SELECT min(ts_ns) FROM samples)", "(SELECT ts_start FROM win)").replace("(SELECT max(ts_ns) FROM samples)", "(SELECT ts_end FROM win)")
_CEIL = "yc AS (" + TS.ORACLES["agg24_sampled_ceilings"].replace(f"WITH {TS.SHAPE}, cw AS", "WITH cw AS") + ")"
_ON_SAMPLES = f" UNION ALL BY NAME (SELECT{_SERIES})"
_CEIL_ROWS = [
    row_sql(fid, "'unjudged'", "'fyi'", f"'{metric}'", "ceiling", "bytes_per_s", "streams", "0", kind="connection", domain="client", text="note", src="(SELECT * FROM yc, win)", where=f"direction = '{way}'")
    for fid, metric, way in (("recv_ceiling", "recv_window_ceiling", "down"), ("bdp_ceiling", "bdp_ceiling", "up"))
]
_OPEN = S.CONNS.replace("JOIN region ON n_regionkey = r_regionkey)", "JOIN region ON n_regionkey = r_regionkey WHERE false)")
_POOL = floors_sql().split("pool AS (", 1)[1].split("),\nmix", 1)[0]
_OPEN_POOL = f"""SELECT {S.mid('min_rtt_us')} AS floor_us, count(min_rtt_us) AS j, count(*) - count(min_rtt_us) AS x, (SELECT count(DISTINCT sock_cookie) FILTER (WHERE sent > 0 OR retrans > 0) FROM st) AS n,
  (SELECT CAST(sum(sent) AS BIGINT) FROM st) AS sent, (SELECT CAST(sum(retrans) AS BIGINT) FROM st) AS rtx FROM samples"""
ORACLES["agg29_capture_report"] = full_report_sql(floors=floors_sql().replace(S.SAMPLES, _CHAIN), more=_ON_SAMPLES)
ORACLES["agg8_agg24_agg29_open_capture_report"] = full_report_sql(
    floors=floors_sql(_OPEN).replace(S.SAMPLES, f"{_CHAIN}, {_CEIL}").replace(_POOL, _OPEN_POOL), more=_ON_SAMPLES + " UNION ALL BY NAME (" + " UNION ALL ".join(_CEIL_ROWS) + ")"
)
