from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.plans import findings as FD
from tidemark.plans import timeseries as TS
from tidemark.plans.scorecard import capture_window
from tidemark.session import materialize
from tidemark.sources import tables as T

TIES = T.SAMPLE_TIES


def _segments(s, d, store=False):
    return TS.segments(T.samples(s, d, sliced=True), TIES, store=store)


def _seg(s, d, store=False):
    seg = _segments(s, d, store)
    stats = TS.segment_stats(seg)
    return seg, stats if TS.known(seg) and not store else materialize(stats, "segment-stats")


def _shapes(s, d):
    return materialize(TS.throughput_shapes(*_seg(s, d), TIES), "shapes")


def _rates(s, d):
    rates = TS.interval_rates(*_seg(s, d), TIES)
    return rates if TS.known(rates) else materialize(rates, "rates")


def _sustained(s, d):
    rates = _rates(s, d)
    peaks = TS.robust_peaks(rates, TIES)
    return TS.sustained_rates(rates, peaks if TS.known(rates) else materialize(peaks, "peaks"))


def _agg(s, d):
    return TS.aggregate_buckets(*_seg(s, d, store=True))


def _ceilings(s, d):
    seg, st = _seg(s, d, store=True)
    return TS.sampled_ceilings(seg, st, materialize(TS.throughput_shapes(seg, st, TIES), "shapes"))


QUERIES = {
    "ts1_segments": lambda s, d: _segments(s, d)
    .groupBy("sock_cookie", "seg")
    .agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1")),
    "ts2_send_deltas": lambda s, d: TS.send_deltas(_segments(s, d)),
    "ts3_segment_direction": lambda s, d: _seg(s, d)[1].select("sock_cookie", "seg", "direction", "sent", "retrans"),
    "ts4_interval_rates": lambda s, d: _rates(s, d).groupBy("sock_cookie", "seg", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.max("rate").alias("max_rate"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    ),
    "ts5_robust_peak": lambda s, d: TS.robust_peaks(_rates(s, d), TIES),
    "ts6_sustained_rate": _sustained,
    "ts7_ts8_throughput_shape": lambda s, d: _shapes(s, d),
    "ts8_loss_timeline": lambda s, d: TS.loss_timeline(TS.ramp_summary(_shapes(s, d))),
    "ts9_bufferbloat": lambda s, d: TS.queueing(*_seg(s, d)),
    "ts10_aggregate_buckets": _agg,
    "ts10_aggregate_throughput": lambda s, d: TS.aggregate_throughput(materialize(_agg(s, d), "buckets")),
    "ts11_throughput_ramp": lambda s, d: TS.ramp_summary(_shapes(s, d)),
    "ts_series_rows": lambda s, d: FD.flatten(
        TS.series_rows(T.samples(s, d, sliced=True), capture_window(T.sample_clock(s, d)), TIES)
    ),
    "agg24_sampled_ceilings": _ceilings,
}

_O = "ts_ns, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
SEG = S.SAMPLES + f""",
p AS (SELECT *, lag(ts_ns) OVER w AS pts, lag(bytes_recv) OVER w AS pr, lag(bytes_sent) OVER w AS ps, lag(total_retrans) OVER w AS pt, lag(rcv_ooopack) OVER w AS po
  FROM samples WINDOW w AS (PARTITION BY sock_cookie ORDER BY {_O})),
q AS (SELECT *, coalesce(bytes_recv < pr OR bytes_sent < ps, false) AS rst FROM p),
seg AS (SELECT * EXCLUDE (pts, pr, ps, pt, po, rst), CASE WHEN NOT rst THEN pts END AS pts, CASE WHEN NOT rst THEN pr END AS pr, CASE WHEN NOT rst THEN ps END AS ps,
  CASE WHEN NOT rst THEN pt END AS pt, CASE WHEN NOT rst THEN po END AS po,
  CAST(sum(CAST(rst AS INTEGER)) OVER (PARTITION BY sock_cookie ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM q),
st AS (SELECT sock_cookie, seg, count(*) AS n, min(ts_ns) AS t0, max(ts_ns) AS t1, max(bytes_sent) AS ls, max(bytes_recv) AS lr, max(bytes_sent) - min(bytes_sent) AS sent,
  greatest(arg_max(total_retrans, ts_ns) - arg_min(total_retrans, ts_ns), 0) AS retrans, min(min_rtt_us) AS floor_us, max(rcv_wnd) AS mw,
  CASE WHEN max(bytes_sent) > max(bytes_recv) AND max(bytes_sent) >= 65536 THEN 'up' WHEN max(bytes_recv) > max(bytes_sent) AND max(bytes_recv) >= 65536 THEN 'down' END AS direction
  FROM seg GROUP BY 1, 2)
"""
RATES = SEG + f""",
rt AS (SELECT * FROM (SELECT g.sock_cookie, g.seg, g.ts_ns, l_orderkey, l_linenumber, l_partkey, l_extendedprice, direction,
  CASE WHEN direction = 'down' THEN (CAST(pts AS DOUBLE) + CAST(ts_ns AS DOUBLE)) / 2.0 - CAST(t0 AS DOUBLE) ELSE CAST(ts_ns AS DOUBLE) - CAST(t0 AS DOUBLE) END AS t,
  CASE WHEN direction = 'down' THEN CASE WHEN ts_ns > pts THEN CAST(bytes_recv - pr AS DOUBLE) / ((ts_ns - pts) / 1e9) END ELSE CAST(delivery_rate_bps AS DOUBLE) END AS rate
  FROM seg g JOIN st ON g.sock_cookie = st.sock_cookie AND g.seg = st.seg WHERE direction IS NOT NULL) WHERE rate IS NOT NULL),
pk AS (SELECT sock_cookie, seg, count(*) AS n_rates, CASE WHEN count(*) < 3 THEN max(rate) ELSE max(m3) END AS peak FROM
  (SELECT *, (rate + lead(rate, 1) OVER w + lead(rate, 2) OVER w) / 3.0 AS m3 FROM rt WINDOW w AS (PARTITION BY sock_cookie, seg ORDER BY {_O})) GROUP BY 1, 2),
su AS (SELECT pk.sock_cookie, pk.seg, n_rates, peak, coalesce({S.mid('rate', 'rate >= 0.05::DOUBLE * peak')}, peak) AS sustained FROM pk JOIN rt USING (sock_cookie, seg) GROUP BY 1, 2, 3, 4)
"""
SHAPE = RATES + """,
wi AS (SELECT *, e - s AS aw, n_rates >= 6 AND e - s > 0 AND peak > 0 AS judgeable FROM (SELECT su.sock_cookie, su.seg, direction, n_rates, peak, sustained,
  min(t) FILTER (WHERE rate >= 0.05::DOUBLE * peak) AS s, max(t) FILTER (WHERE rate >= 0.05::DOUBLE * peak) AS e FROM su JOIN rt USING (sock_cookie, seg) GROUP BY ALL)),
sh AS (SELECT wi.sock_cookie, wi.seg, avg(rate) FILTER (WHERE judgeable AND t >= s AND t <= e AND t - s >= aw / 3.0 AND t - s <= aw * 2.0 / 3.0) AS m,
  avg(rate) FILTER (WHERE judgeable AND t >= s AND t <= e AND t - s >= aw * 2.0 / 3.0 AND t - s <= aw) AS l,
  min((t - s) / aw * 100.0) FILTER (WHERE judgeable AND t >= s AND t <= e AND rate >= 0.9::DOUBLE * peak) AS t90_pct FROM wi JOIN rt USING (sock_cookie, seg) GROUP BY 1, 2),
x AS (SELECT g.*, st.t0, st.t1, wi.direction, s, e, aw, judgeable, (CAST(pts AS DOUBLE) + CAST(ts_ns AS DOUBLE)) / 2.0 - CAST(t0 AS DOUBLE) AS md,
  greatest(CASE WHEN wi.direction = 'down' THEN rcv_ooopack - po ELSE total_retrans - pt END, 0) AS lost FROM seg g JOIN st USING (sock_cookie, seg) JOIN wi USING (sock_cookie, seg)),
ev AS (SELECT sock_cookie, seg, CAST(coalesce(sum(lost) FILTER (WHERE judgeable AND md >= s AND md <= e AND (md - s) / aw < 1.0::DOUBLE / 3.0), 0) AS BIGINT) AS loss_0,
  CAST(coalesce(sum(lost) FILTER (WHERE judgeable AND md >= s AND md <= e AND (md - s) / aw >= 1.0::DOUBLE / 3.0 AND (md - s) / aw < 2.0::DOUBLE / 3.0), 0) AS BIGINT) AS loss_1,
  CAST(coalesce(sum(lost) FILTER (WHERE judgeable AND md >= s AND md <= e AND (md - s) / aw >= 2.0::DOUBLE / 3.0), 0) AS BIGINT) AS loss_2,
  coalesce(bool_or(direction = 'up' AND t1 > t0 AND rate_app_limited AND CAST(ts_ns AS DOUBLE) - CAST(t0 AS DOUBLE) >= 2.0::DOUBLE / 3.0 * (CAST(t1 AS DOUBLE) - CAST(t0 AS DOUBLE))), false) AS app_limited
  FROM x GROUP BY 1, 2),
shapes AS (SELECT sock_cookie, seg, direction, n_rates, peak, sustained, CASE WHEN NOT judgeable THEN 'short' WHEN coalesce(m > 0 AND l > 1.2::DOUBLE * m, false) THEN 'ramping'
  WHEN sustained >= 0.8::DOUBLE * peak THEN 'steady' ELSE 'bursty' END AS shape, t90_pct, app_limited, judgeable, loss_0, loss_1, loss_2
  FROM wi JOIN sh USING (sock_cookie, seg) JOIN ev USING (sock_cookie, seg))
"""
RAMP = SHAPE + f""",
ramp AS (SELECT count(*) AS streams, count(*) FILTER (WHERE direction = 'down') AS downloads, count(*) FILTER (WHERE direction = 'up') AS uploads,
  count(*) FILTER (WHERE shape = 'steady') AS steady, count(*) FILTER (WHERE shape = 'bursty') AS bursty, count(*) FILTER (WHERE shape = 'ramping') AS ramping,
  count(*) FILTER (WHERE shape = 'short') AS short, count(*) FILTER (WHERE app_limited) AS app_limited,
  {', '.join(f"CAST(coalesce(sum(loss_{i}) FILTER (WHERE judgeable AND direction = '{d}'), 0) AS BIGINT) AS {d}_loss_{i}" for d in ('down', 'up') for i in range(3))},
  {S.mid('sustained')} AS sustained, greatest({S.mid('peak')}, {S.mid('sustained')}) AS peak, {S.mid('t90_pct')} AS t90_pct FROM shapes)
"""
LOSS = RAMP + ", loss AS (" + " UNION ALL ".join(
    f"""SELECT '{d}' AS direction, {d}_loss_0 + {d}_loss_1 + {d}_loss_2 AS events, CASE WHEN greatest({d}_loss_0, {d}_loss_1, {d}_loss_2) > 0.5 * ({d}_loss_0 + {d}_loss_1 + {d}_loss_2)
 THEN CASE WHEN {d}_loss_2 >= greatest({d}_loss_0, {d}_loss_1) THEN 'late' WHEN {d}_loss_1 >= {d}_loss_0 THEN 'mid' ELSE 'early' END ELSE 'spread' END AS phase FROM ramp
 WHERE {d}_loss_0 + {d}_loss_1 + {d}_loss_2 > 0""" for d in ("down", "up")) + ")"
BLOAT = """bl AS (SELECT sock_cookie, seg, max(ratio) AS worst_ratio, arg_min(th, ts_ns) FILTER (WHERE ratio >= 2) AS onset FROM
 (SELECT g.sock_cookie, g.seg, ts_ns, srtt_us / floor_us AS ratio, CASE WHEN rel < 1.0::DOUBLE / 3.0 THEN 0 WHEN rel < 2.0::DOUBLE / 3.0 THEN 1 ELSE 2 END AS th FROM
  (SELECT s.*, floor_us, (CAST(ts_ns AS DOUBLE) - CAST(t0 AS DOUBLE)) / greatest(CAST(t1 AS DOUBLE) - CAST(t0 AS DOUBLE), 1.0) AS rel FROM seg s JOIN st USING (sock_cookie, seg) WHERE floor_us > 0) g) GROUP BY 1, 2)"""
BUCKETS = """iv AS (SELECT g.sock_cookie, direction, pts AS ta, ts_ns AS tb, CAST(greatest(CASE WHEN direction = 'down' THEN bytes_recv - pr ELSE bytes_sent - ps END, 0) AS DOUBLE) AS bytes,
 pts // 1000000000 AS b0, (ts_ns - 1) // 1000000000 AS b1 FROM seg g JOIN st USING (sock_cookie, seg) WHERE direction IS NOT NULL AND ts_ns > pts),
ed AS (SELECT direction, sock_cookie, b0 AS bucket, bytes * (least(tb, (b0 + 1) * 1000000000) - ta) / (tb - ta) AS bytes, ta AS lo, least(tb, (b0 + 1) * 1000000000) AS hi FROM iv
 UNION ALL SELECT direction, sock_cookie, b1, bytes * (tb - b1 * 1000000000) / (tb - ta), b1 * 1000000000, tb FROM iv WHERE b1 > b0),
eb AS (SELECT direction, bucket, sum(bytes) AS bytes, count(DISTINCT sock_cookie) AS sockets, min(lo) AS lo, max(hi) AS hi FROM ed GROUP BY 1, 2),
fr AS (SELECT direction, b0 + 1 AS f, b1 AS t, CAST(bytes * 1000000000 / (tb - ta) AS DECIMAL(38, 6)) AS r FROM iv WHERE b1 > b0 + 1),
sp AS (SELECT direction, bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) AS DECIMAL(38, 6)) AS r FROM (SELECT direction, f AS bucket, 1 AS n, r FROM fr UNION ALL SELECT direction, t, -1, -r FROM fr) GROUP BY 1, 2),
mk AS (SELECT direction, bucket FROM eb UNION SELECT direction, bucket + 1 FROM eb UNION SELECT direction, bucket FROM sp),
lv AS (SELECT direction, bucket, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS full_, CAST(sum(coalesce(r, 0)) OVER w AS DOUBLE) AS fb, lead(bucket) OVER w AS nx
 FROM mk LEFT JOIN sp USING (direction, bucket) WINDOW w AS (PARTITION BY direction ORDER BY bucket)),
bk AS (SELECT direction, bucket, coalesce(nx - bucket, 1) AS buckets, coalesce(bytes, 0) + fb AS bytes, coalesce(sockets, 0) + full_ AS sockets,
 CASE WHEN full_ > 0 THEN 1.0::DOUBLE ELSE (hi - lo) / 1e9 END AS covered_s FROM lv LEFT JOIN eb USING (direction, bucket)),
bb AS (SELECT *, bytes / covered_s AS rate FROM bk WHERE sockets > 0 AND covered_s >= 0.25)"""
_AGG = """cw AS (SELECT direction, rate, sum(buckets) OVER (PARTITION BY direction ORDER BY rate) AS c, sum(buckets) OVER (PARTITION BY direction) AS n FROM bb),
ag AS (SELECT direction, peak, max_sockets, typical FROM (SELECT direction, max(rate) AS peak, max(sockets) AS max_sockets FROM bb GROUP BY 1 HAVING max(sockets) >= 2)
 JOIN (SELECT direction, (min(rate) FILTER (WHERE c >= (n + 1) // 2) + min(rate) FILTER (WHERE c >= n // 2 + 1)) / 2 AS typical FROM cw GROUP BY 1) USING (direction))"""
_FLAT = """'connection' AS sample_kind, NULL::VARCHAR AS s3_op, NULL::VARCHAR AS bucket, NULL::VARCHAR AS prefix_hash, NULL::VARCHAR AS region, NULL::BIGINT AS app_pid,
 (SELECT min(ts_ns) FROM samples) AS ts_start, (SELECT max(ts_ns) FROM samples) AS ts_end, NULL::BIGINT AS baseline_rtt_us, NULL::DOUBLE AS ratio_to_rtt, CAST(0 AS BIGINT) AS excluded,
 'network' AS domain, 'unjudged' AS severity"""

ORACLES = {
    "ts1_segments": f"WITH {SEG} SELECT sock_cookie, seg, n, t0, t1 FROM st",
    "ts2_send_deltas": f"""WITH {SEG} SELECT CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(retrans) AS BIGINT) AS retrans,
 count(DISTINCT sock_cookie) FILTER (WHERE sent > 0 OR retrans > 0) AS streams FROM st""",
    "ts3_segment_direction": f"WITH {SEG} SELECT sock_cookie, seg, direction, sent, retrans FROM st",
    "ts4_interval_rates": f"""WITH {RATES} SELECT sock_cookie, seg, direction, count(*) AS n, max(rate) AS max_rate, min(t) AS t_min, max(t) AS t_max FROM rt GROUP BY 1, 2, 3""",
    "ts5_robust_peak": f"WITH {RATES} SELECT * FROM pk",
    "ts6_sustained_rate": f"WITH {RATES} SELECT * FROM su",
    "ts7_ts8_throughput_shape": f"WITH {SHAPE} SELECT * FROM shapes",
    "ts8_loss_timeline": f"WITH {LOSS} SELECT * FROM loss",
    "ts9_bufferbloat": f"WITH {SEG}, {BLOAT} SELECT * FROM bl",
    "ts10_aggregate_buckets": f"WITH {SEG}, {BUCKETS} SELECT * FROM bb",
    "ts10_aggregate_throughput": f"WITH {SEG}, {BUCKETS}, {_AGG} SELECT * FROM ag",
    "ts11_throughput_ramp": f"WITH {RAMP} SELECT * FROM ramp",
    "ts_series_rows": f"""WITH {LOSS}, {BLOAT}, {BUCKETS}, {_AGG}
SELECT 'throughput_ramp' AS finding_id, 'fyi' AS verdict, 'throughput_sustained_bps' AS metric, sustained AS value_num, NULL::VARCHAR AS value_str, 'bytes_per_s' AS unit, streams AS judged, {_FLAT} FROM ramp
UNION ALL SELECT 'throughput_aggregate_' || direction, 'fyi', 'throughput_aggregate_bps', peak, NULL, 'bytes_per_s', CASE WHEN direction = 'down' THEN (SELECT downloads FROM ramp) ELSE (SELECT uploads FROM ramp) END, {_FLAT} FROM ag
UNION ALL SELECT CASE WHEN direction = 'down' THEN 'loss_timeline_reorder' ELSE 'loss_timeline_retrans' END, 'fyi', 'loss_events', CAST(events AS DOUBLE), phase, 'count',
 CASE WHEN direction = 'down' THEN (SELECT downloads FROM ramp) ELSE (SELECT uploads FROM ramp) END, {_FLAT} FROM loss
UNION ALL SELECT 'bufferbloat_onset', CASE WHEN r >= 2 THEN 'bloated' WHEN r > 1.2 THEN 'mild' ELSE 'flat' END, 'srtt_inflation_ratio', r, CASE WHEN r >= 2 THEN (['early', 'mid', 'late'])[onset + 1] END, 'ratio', (SELECT streams FROM ramp), {_FLAT}
 FROM (SELECT worst_ratio AS r, onset FROM bl ORDER BY worst_ratio DESC, sock_cookie, seg LIMIT 1)""",
    "agg24_sampled_ceilings": f"""WITH {SHAPE}, cw AS (SELECT sock_cookie, seg, {S.mid('snd_cwnd', 'snd_cwnd > 0')} AS cwnd FROM seg GROUP BY 1, 2),
 z AS (SELECT st.sock_cookie, st.direction, CASE WHEN st.direction = 'down' THEN mw / (floor_us / 1e6) ELSE cwnd * 1460.0 / (floor_us / 1e6) END AS ceiling, sustained, app_limited
  FROM st JOIN cw USING (sock_cookie, seg) LEFT JOIN shapes h USING (sock_cookie, seg) WHERE floor_us > 0 AND st.direction IS NOT NULL),
 y AS (SELECT direction, {S.mid('ceiling')} AS ca, {S.mid('ceiling', 'sustained IS NOT NULL')} AS ck, {S.mid('sustained')} AS achieved, count(DISTINCT sock_cookie) AS streams,
  count(*) FILTER (WHERE coalesce(app_limited, false) AND sustained < 0.5::DOUBLE * ceiling) AS app_limited FROM z WHERE ceiling IS NOT NULL GROUP BY 1)
 SELECT direction, coalesce(ck, ca) AS ceiling, achieved, streams, app_limited, CASE WHEN achieved IS NULL THEN 'not measured' WHEN direction = 'down' AND achieved / coalesce(ck, ca) >= 0.7 THEN 'receive-window-limited'
 WHEN direction = 'down' THEN 'under-ceiling' WHEN achieved / coalesce(ck, ca) < 0.5 AND app_limited > 0 THEN 'app-limited' WHEN achieved / coalesce(ck, ca) < 0.5 THEN 'under-ceiling' ELSE 'near-ceiling' END AS note FROM y""",
}
