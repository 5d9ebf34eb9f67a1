"""The capture health report: every latency against its own round-trip floor.

``op_facts`` and ``conn_facts`` reduce the records to one row of scalars each; every
report row is then a function of those scalars. Three marks beside ok/warn: fyi and
n/a are 'unjudged', advisory is advisory. A missing denominator never reads healthy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.plans import findings as FD
from tidemark.plans import floors as FL
from tidemark.plans import timeseries as TS
from tidemark.plans.scorecard import capture_window
from tidemark.session import materialize

# Titles of the report rows.
TITLES = {
    "baseline_rtt": "baseline RTT",
    "dns_cold": "DNS, cold resolve",
    "tcp_connect": "TCP connect",
    "ttfb_new": "TTFB, new conn",
    "ttfb_reused": "TTFB, reused conn",
    "retransmit_rate": "retransmit rate",
    "http_errors": "HTTP errors",
    "reuse_rate": "connection reuse",
    "s3_throttle": "throttling (429/503)",
    "s3_server_errors": "server errors (5xx)",
    "s3_client_errors": "client errors (4xx)",
    "s3_throughput": "GetObject throughput",
}
CLIENT_ROWS = ["http_errors", "reuse_rate", "send_bottleneck", "bdp_ceiling", "recv_ceiling"]
CONNECTION_ROWS = [
    "baseline_rtt", "retransmit_rate", "path_min_rtt", "tls_handshake", "send_bottleneck", "bdp_ceiling",
    "recv_ceiling", "loss_shape", "throughput_ramp", "throughput_aggregate_down", "throughput_aggregate_up",
    "bufferbloat_onset", "loss_timeline_reorder", "loss_timeline_retrans",
]


def good() -> Column:
    return C.timeable()


def op_facts(ops: DataFrame, cfg: Config = DEFAULT, needs: set[str] = frozenset({"spans", "tails", "tput"})) -> DataFrame:
    """One row: counts and order statistics of the requests.

    ``needs`` limits the order statistics to some row groups; tails also need ``floor_us``.
    """
    g, reused, t = good(), F.col("connection_reused"), F.col("ttfb_ns")
    cold = F.col("dns_latency_ns").isNotNull() & ~F.coalesce("dns_cache_hit", F.lit(False))
    st = F.col("http_status")
    cls = C.status_class(st)
    is_get = F.col("s3_op") == "GetObject"
    measured = is_get & (F.col("download_ns") > 0) & F.col("content_length").isNotNull()
    values, stats, sides = {}, [], []
    if "spans" in needs:
        values |= {"dns": F.when(g & cold, F.col("dns_latency_ns")), "tcp": F.when(g, F.col("tcp_connect_ns"))}
        stats += [Stat("dns", "dns", "mid"), Stat("tcp", "tcp", "mid")]
    if "tput" in needs:
        values["tput"] = F.when(g & measured, F.col("content_length") / F.col("download_ns") * 1e3)
        stats.append(Stat("tput", "tput", "mid"))
    for side, on in (("new", ~reused), ("reused", reused)):
        sides.append(F.count_if(on & t.isNotNull()).alias(f"cand_{side}"))
        if needs & {"spans", "tails"}:
            values[f"{side}_ns"] = F.when(g & on, t)
        if "spans" in needs:
            stats.append(Stat(f"{side}_mid", f"{side}_ns", "mid"))
        if "tails" in needs:
            floor_ms = F.col("floor_us") / 1e3
            judged = g & on & F.col("floor_us").isNotNull()
            values |= {f"{side}_jns": F.when(judged, t), f"{side}_ratio": F.when(judged, t / 1e6 / floor_ms)}
            for p in (95, 99):
                stats += [
                    Stat(f"{side}_all_p{p}", f"{side}_ns", p / 100.0),
                    Stat(f"{side}_p{p}", f"{side}_jns", p / 100.0),
                    Stat(f"{side}_ratio_p{p}", f"{side}_ratio", p / 100.0),
                ]
            f = F.when(judged & t.isNotNull(), floor_ms * 1e3)
            sides += [F.min(f).alias(f"{side}_floor_lo"), F.max(f).alias(f"{side}_floor_hi")]
    counts = ops.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(g).alias("good"),
        F.count_if(~F.col("partial")).alias("nonpartial"),
        F.count_if(~F.col("partial") & reused).alias("nonpartial_reused"),
        F.count(st).alias("answered"),
        F.count_if(st >= 400).alias("errors"),
        F.count_if(cls == "throttle").alias("throttle"),
        F.count_if(cls == "server").alias("server"),
        F.count_if(cls.isin("forbidden", "not_found", "bad_request", "client")).alias("client"),
        F.count_if(cold).alias("cand_dns"),
        F.count("tcp_connect_ns").alias("cand_tcp"),
        F.count_if(measured).alias("cand_tput"),
        *sides,
    )
    if not stats:
        return counts
    return counts.withColumn("q", exact_quantiles(ops, [], values, stats).select(F.struct("*")).scalar())


def with_capture(
    facts: DataFrame,
    ops: DataFrame,
    conns: DataFrame,
    samples: DataFrame,
    cfg: Config = DEFAULT,
    sampled_send: DataFrame | None = None,
) -> DataFrame:
    """Attach the capture-wide scalars: pooled floor, path flag, window, connection totals.

    ``sampled_send`` is the one-row send delta of the in-flight samples (sent, retrans, streams).
    """
    if sampled_send is None:
        facts = facts.withColumn("d", F.expr("CAST(NULL AS struct<sent:bigint,retrans:bigint,streams:bigint>)"))
    else:
        facts = facts.withColumn("d", sampled_send.select(F.struct("sent", "retrans", "streams")).scalar())
    totals = conns.agg(
        F.count(F.lit(1)).alias("conns"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.sum("retransmits"), F.lit(0)).alias("rtx"),
    )
    return (
        facts.withColumn("p", FL.pooled_floor(conns, samples, cfg).select(F.struct("*")).scalar())
        .withColumn("mixed", FL.multi_path(conns, cfg).scalar())
        .withColumn("w", capture_window(ops, conns, samples).select(F.struct("*")).scalar())
        .withColumn("c", totals.select(F.struct("*")).scalar())
        .withColumn("row_rtt_ms", F.when(~F.col("mixed"), F.col("p.floor_us") / 1000.0))
        .withColumn("baseline", F.col("p.floor_us").cast("bigint"))
    )


def _row(fid: str, severity, verdict, metric, value, unit: str, judged, excluded, **more) -> Column:
    return FD.record(
        finding_id=fid,
        domain=more.pop("domain", "client" if fid in CLIENT_ROWS else "network"),
        severity=severity,
        verdict=verdict,
        title=TITLES.get(fid, fid),
        metric=metric,
        value_num=value,
        unit=unit,
        judged=judged,
        excluded=excluded,
        sample_kind="connection" if fid in CONNECTION_ROWS else "operation",
        ts_start=F.col("w.ts_start"),
        ts_end=F.col("w.ts_end"),
        **more,
    )


def _severity(ok: Column) -> Column:
    return F.when(ok, "healthy").otherwise("warn")


def floor_row(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    """The round-trip floor every span is judged against."""
    return [(
            F.col("p.floor_us").isNotNull(),
            _row("baseline_rtt", "unjudged", "floor", "baseline_rtt", F.col("p.floor_us") / 1000.0, "ms",
                 F.col("p.judged"), F.col("p.excluded"), baseline_rtt_us=F.col("baseline")),
    )]


def span_rows(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    """Cold resolve (reported only), TCP connect and TTFB on new and reused connections."""
    q = lambda n: F.col(f"q.{n}")
    rows = [(
        q("dns").isNotNull(),
        _row("dns_cold", "unjudged", "fyi", "dns_cold", q("dns") / 1e6, "ms", q("n_dns"), F.col("cand_dns") - q("n_dns")),
    )]
    for fid, stat, n, cand, mult, ok_word in (
        ("tcp_connect", "tcp", "n_tcp", "cand_tcp", cfg.tcp_connect_rtt_mult, "expected"),
        ("ttfb_new", "new_mid", "n_new_ns", "cand_new", cfg.ttfb_rtt_mult, "expected"),
        ("ttfb_reused", "reused_mid", "n_reused_ns", "cand_reused", cfg.ttfb_rtt_mult, "good"),
    ):
        v = q(stat) / 1e6
        ratio = v / F.col("row_rtt_ms")
        ok = ratio <= mult
        rows.append((
            v.isNotNull(),
            _row(fid, F.when(ratio.isNull(), "unjudged").otherwise(_severity(ok)),
                 F.when(ratio.isNull(), "n/a").when(ok, ok_word).otherwise("high"),
                 fid, v, "ms", q(n), F.col(cand) - q(n),
                 ratio_to_rtt=ratio, threshold=f"<= {mult}xRTT",
                 baseline_rtt_us=F.when(ratio.isNotNull(), F.col("baseline"))),
        ))
    return rows


def retransmit_row(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    """Retransmits per sent segment; in-flight deltas stand in when no socket sent before closing."""
    use = F.col("c.sent") > 0
    pick = lambda closed, live: F.when(use, F.col(f"c.{closed}")).otherwise(F.coalesce(f"d.{live}", F.lit(0)))
    sent, rtx, streams = pick("sent", "sent"), pick("rtx", "retrans"), pick("conns", "streams")
    segs = F.floor(sent / cfg.mss_bytes)
    enough = segs >= cfg.min_directional_bytes // cfg.mss_bytes
    rate = F.when(enough, rtx / segs)
    ok = rate <= cfg.rtx_rate_max
    return [(
        F.lit(True),
        _row("retransmit_rate", F.when(rate.isNull(), "unjudged").otherwise(_severity(ok)),
             F.when(rate.isNull(), "n/a").when(ok, "clean").otherwise("loss"),
             "retransmit_rate", rate, "ratio", streams, 0,
             threshold=F.when(enough, f"<= {cfg.rtx_rate_max}")),
    )]


def http_error_row(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    none = F.col("answered") == 0
    clean = F.col("errors") == 0
    return [(
            F.lit(True),
            _row("http_errors", F.when(none, "unjudged").otherwise(_severity(clean)),
                 F.when(none, "n/a").when(clean, "healthy").otherwise("errors"),
                 "http_errors", F.when(~none, F.col("errors")), "count",
                 F.col("answered"), F.col("total") - F.col("answered"), threshold="== 0"),
    )]


def reuse_row(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    share = F.col("nonpartial_reused") / F.when(F.col("nonpartial") > 0, F.col("nonpartial"))
    ok = share >= cfg.reuse_ratio_min
    return [(
            F.col("nonpartial") >= cfg.min_reuse_sample,
            _row("reuse_rate", _severity(ok), F.when(ok, "good").otherwise("low"), "reuse_rate", share, "ratio",
                 F.col("nonpartial"), F.col("total") - F.col("nonpartial"), threshold=f">= {cfg.reuse_ratio_min}"),
    )]


def tail_rows(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    """p95/p99 of TTFB and, ranked separately, of TTFB over each request's own floor."""
    rows = []
    for side in ("new", "reused"):
        for p, least, mult in ((95, cfg.min_tail_sample, cfg.tail_rtt_mult), (99, cfg.min_p99_sample, cfg.p99_rtt_mult)):
            fid = f"ttfb_{side}_p{p}"
            n, j = F.col(f"q.n_{side}_ns"), F.col(f"q.n_{side}_jns")
            ratio = F.col(f"q.{side}_ratio_p{p}")
            few = j < least
            blind = (ratio <= mult) & ((n - j) / F.when(n > 0, n) > 1.0 - p / 100.0)
            na = few | F.coalesce(blind, F.lit(False))
            lo, hi = F.col(f"{side}_floor_lo"), F.col(f"{side}_floor_hi")
            rows.append((
                n >= least,
                _row(fid, F.when(na, "unjudged").otherwise(_severity(ratio <= mult)),
                     F.when(na, "n/a").when(ratio <= mult, "expected").otherwise("high"),
                     fid, F.when(na, F.col(f"q.{side}_all_p{p}")).otherwise(F.col(f"q.{side}_p{p}")) / 1e6, "ms",
                     F.when(few, 0).otherwise(j), F.when(few, n).otherwise(n - j),
                     ratio_to_rtt=F.when(~na, ratio), threshold=f"<= {mult}xRTT",
                     baseline_rtt_us=F.when(~na & (lo == hi), F.round(lo).cast("bigint"))),
            ))
    return rows


def status_rows(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    """Throttle, server and client error counts over the answered requests."""
    rows = []
    for fid, col, verdict, metric in (
        ("s3_throttle", "throttle", "throttle", "s3_status_throttle"),
        ("s3_server_errors", "server", "retryable", "s3_status_server"),
        ("s3_client_errors", "client", "client", "s3_status_client"),
    ):
        rows.append((
            F.col(col) > 0,
            _row(fid, "warn", verdict, metric, F.col(col), "count", F.col("answered"),
                 F.col("total") - F.col("answered"), domain="s3", threshold="== 0"),
        ))
    return rows


def throughput_row(cfg: Config = DEFAULT) -> list[tuple[Column, Column]]:
    v, n = F.col("q.tput"), F.col("q.n_tput")
    return [(
            v.isNotNull(),
            _row("s3_throughput", "advisory", "fyi", "s3_get_throughput", v * 1e6, "bytes_per_s", n,
                 F.col("cand_tput") - n, domain="s3", s3_op="GetObject"),
    )]


def class_stats(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per operation class: TTFB, its multiple of the own floor, and server think time."""
    o = ops.withColumn("s3_op", C.sanitize_term(F.col("s3_op"))).where(F.col("s3_op").isNotNull())
    g = good()
    ms, floor = F.col("ttfb_ns") / 1e6, F.col("floor_us") / 1e3
    judged = g & F.col("floor_us").isNotNull()
    order = exact_quantiles(
        o,
        ["s3_op"],
        {
            "all": F.when(g, ms),
            "j": F.when(judged, ms),
            "ratio": F.when(judged, ms / floor),
            "think": F.when(judged & ms.isNotNull(), F.greatest(ms - floor, F.lit(0.0))),
        },
        [Stat("ttfb_all_ms", "all", "mid"), Stat("ttfb_ms", "j", "mid"), Stat("ratio", "ratio", "mid"), Stat("think_ms", "think", "mid")],
    )
    span = F.when(judged & ms.isNotNull(), floor * 1e3)
    pop = o.groupBy("s3_op").agg(
        F.count("ttfb_ns").alias("candidates"), F.min(span).alias("floor_lo"), F.max(span).alias("floor_hi")
    )
    return order.join(pop, "s3_op").withColumnRenamed("n_j", "judged").withColumnRenamed("n_all", "timed")


def class_rows(ops: DataFrame, window: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    st = class_stats(ops, cfg).where(F.col("timed") > 0).withColumn("w", window.select(F.struct("*")).scalar())
    ok = F.col("ratio") <= cfg.ttfb_rtt_mult
    na = F.col("ratio").isNull() | (ok & (F.col("judged") < cfg.min_judge_sample))
    return FD.emit_each(
        st,
        [(
            F.lit(True),
            _row("s3_ttfb", F.when(na, "unjudged").otherwise(_severity(ok)),
                 F.when(na, "n/a").when(ok, "expected").otherwise("high"),
                 "s3_ttfb", F.when(F.col("judged") > 0, F.col("ttfb_ms")).otherwise(F.col("ttfb_all_ms")), "ms",
                 F.col("judged"), F.greatest(F.col("candidates") - F.col("judged"), F.lit(0)),
                 domain="s3", s3_op=F.col("s3_op"), ratio_to_rtt=F.when(~na, F.col("ratio")),
                 threshold=f"<= {cfg.ttfb_rtt_mult}xRTT",
                 baseline_rtt_us=F.when(~na & (F.col("floor_lo") == F.col("floor_hi")), F.round("floor_lo").cast("bigint"))),
        )],
    )


def environment(conns: DataFrame, pooled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Where the client sits, by ordered rules; no row when nothing supports an estimate."""
    srtt = C.usable_rtt(F.col("srtt_us"), cfg)
    f = conns.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("region").alias("r0"), F.max("region").alias("r1"),
        F.min(srtt).alias("lo"), F.max(srtt).alias("hi"),
        F.count_if("cross_region").alias("cross"), F.count_if("via_vpce").alias("vpce"),
    ).withColumn("rtt_ms", pooled.select(F.col("floor_us") / 1000.0).scalar())
    bimodal = F.coalesce(
        (F.col("hi") / F.col("lo") >= cfg.mixed_srtt_ratio) & (F.col("hi") / 1000.0 >= cfg.far_path_ms), F.lit(False)
    )
    many = F.coalesce(F.col("r0") != F.col("r1"), F.lit(False))
    cls = (
        F.when(many, "mixed")
        .when((F.col("n") > 0) & (F.col("cross") == F.col("n")), "cross-region")
        .when(bimodal, "mixed")
        .when(F.col("cross") > 0, "cross-region")
        .when(F.col("rtt_ms") < cfg.far_path_ms, "same-region")
        .when(F.col("rtt_ms").isNotNull(), "wan-or-cross-region")
    )
    return (
        f.withColumn("env", cls)
        .withColumn(
            "confidence",
            F.when(F.col("env").isin("mixed", "cross-region"), "high")
            .when((F.col("rtt_ms") < cfg.same_region_ms) | ((F.col("rtt_ms") < cfg.far_path_ms) & (F.col("vpce") > 0)), "high")
            .when(F.col("rtt_ms") < cfg.far_path_ms, "likely")
            .otherwise("uncertain"),
        )
        .where(F.col("env").isNotNull())
    )


def environment_row(conns: DataFrame, window: DataFrame, pooled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    e = environment(conns, pooled, cfg).withColumn("w", window.select(F.struct("*")).scalar())
    return FD.emit(
        e, finding_id="environment", domain="network", severity="unjudged", verdict=F.col("env"),
        title="deployment environment (estimated)", metric="environment", value_str=F.col("env"), unit="none",
        baseline_rtt_us=(F.col("rtt_ms") * 1000.0).cast("bigint"), judged=F.col("n"), excluded=0,
        sample_kind="connection", ts_start=F.col("w.ts_start"), ts_end=F.col("w.ts_end"),
    )


# -- network path ---------------------------------------------------------------------

def conn_facts(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of path scalars over closed connections."""
    mn, sr, jit = (C.usable_rtt(F.col(c), cfg) for c in ("min_rtt_us", "srtt_us", "rttvar_us"))
    heavy_out, heavy_in = C.send_heavy(cfg), C.recv_heavy(cfg)
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    ceiling = F.when(heavy_out, pos("snd_cwnd") * pos("mss") / (mn / 1e6))
    rate = F.when(ceiling.isNotNull(), pos("delivery_rate_bps")).cast("double")
    recv_ceiling = F.when(heavy_in & (F.col("lifetime_ns") > 0), pos("window_clamp") / (mn / 1e6))
    recv_rate = F.when(recv_ceiling.isNotNull(), F.col("bytes_recv") / (F.col("lifetime_ns") / 1e9))
    values = {
        "min": mn / 1e3, "jit": jit / 1e3, "srtt": sr / 1e3, "infl": sr / mn, "tls": F.col("tls_handshake_ns") / 1e6,
        "bdp": ceiling, "bdp_j": F.when(rate.isNotNull(), ceiling), "rate": rate, "rcv": recv_ceiling, "rcv_rate": recv_rate,
    }
    order = exact_quantiles(conns, [], values, [Stat(f"m_{v}", v, "mid") for v in values])
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts_ns", "sock_cookie")))
    counts = conns.agg(
        F.count(F.lit(1)).alias("conns"),
        total("busy_jiffies", heavy_out).alias("busy"),
        total("rwnd_limited_jiffies", heavy_out).alias("rwnd"),
        total("sndbuf_limited_jiffies", heavy_out).alias("sndbuf"),
        F.count_if(rate.isNotNull() & F.coalesce("app_limited", F.lit(False)) & (rate < 0.5 * ceiling)).alias("app_limited"),
        F.max("reordering").alias("reordering"),
        F.count_if(F.col("ca_state") >= 3).alias("recovery"),
        total("rcv_ooopack", F.lit(True)).alias("ooo"),
        total("dsack_dups", heavy_out).alias("dsack"),
        first("tls_version").alias("tls_version"),
        first("tls_cipher").alias("tls_cipher"),
    )
    return counts.withColumn("q", order.select(F.struct("*")).scalar())


def path_rows(facts: DataFrame, window: DataFrame) -> DataFrame:
    """Reported rows about the path: floor and jitter, handshake, windows, loss shape."""
    q = lambda n: F.col(f"q.{n}")
    f = facts.withColumn("w", window.select(F.struct("*")).scalar())
    n = F.col("conns")
    tls_ratio = q("m_tls") / F.when(q("m_min") > 0, q("m_min"))
    jiffies = F.col("busy") + F.col("rwnd") + F.col("sndbuf")
    high = F.coalesce(F.col("reordering") > 3, F.lit(False))
    loss_metric = (
        F.when(high, "reordering").when(F.col("recovery") > 0, "loss_recovery").when(F.col("ooo") > 0, "rcv_ooopack").otherwise("dsack_dups")
    )
    loss_value = (
        F.when(high, F.col("reordering")).when(F.col("recovery") > 0, F.col("recovery")).when(F.col("ooo") > 0, F.col("ooo")).otherwise(F.col("dsack"))
    )
    bdp_note = (
        F.when((q("m_rate") < 0.5 * q("m_bdp_j")) & (F.col("app_limited") > 0), "app-limited")
        .when(q("m_rate") < 0.5 * q("m_bdp_j"), "under-ceiling")
        .when(q("m_rate").isNotNull(), "near-ceiling")
    )
    rcv_note = F.when(F.coalesce(q("m_rcv_rate"), F.lit(0.0)) / q("m_rcv") >= 0.7, "receive-window-limited").otherwise("under-ceiling")
    infl_note = F.when(q("m_infl") >= 2.0, "inflated").when(q("m_infl").isNotNull(), "stable").otherwise("not judged")
    return FD.emit_each(
        f,
        [
            (q("m_min").isNotNull(), _row("path_min_rtt", "unjudged", "fyi", "min_rtt", q("m_min"), "ms", n, 0, value_str=infl_note)),
            (q("m_tls").isNotNull(), _row("tls_handshake", "unjudged", "fyi", "tls_handshake", q("m_tls"), "ms", n, 0,
                                          ratio_to_rtt=tls_ratio, baseline_rtt_us=F.round(q("m_min") * 1e3).cast("bigint"),
                                          value_str=F.concat_ws("/", "tls_version", F.col("tls_cipher").cast("string")))),
            (jiffies > 0, _row("send_bottleneck", "unjudged", "fyi", "send_free_pct", F.col("busy") / jiffies * 100.0, "none", n, 0)),
            (q("m_bdp").isNotNull(), _row("bdp_ceiling", "unjudged", "fyi", "bdp_ceiling", q("m_bdp"), "bytes_per_s", n, 0, value_str=bdp_note)),
            (q("m_rcv").isNotNull(), _row("recv_ceiling", "unjudged", "fyi", "recv_window_ceiling", q("m_rcv"), "bytes_per_s", n, 0, value_str=rcv_note)),
            (high | (F.col("recovery") > 0) | (F.col("ooo") > 0) | (F.col("dsack") > 0),
             _row("loss_shape", "unjudged", "fyi", loss_metric, loss_value, "count", n, 0)),
        ],
    )


# -- the whole report -------------------------------------------------------------------

# the order statistics a builder reads from op_facts
NEEDS = {span_rows: "spans", tail_rows: "tails", throughput_row: "tput"}
OP_ROWS = [floor_row, span_rows, retransmit_row, http_error_row, tail_rows, reuse_row, status_rows, throughput_row]


def rows(cap: DataFrame, builders: list, cfg: Config = DEFAULT) -> DataFrame:
    """The report rows of some builders, all from the single row of scalars."""
    return FD.emit_each(cap, [c for b in builders for c in b(cfg)])


def report(
    ops: DataFrame,
    conns: DataFrame,
    samples: DataFrame,
    cfg: Config = DEFAULT,
    series: DataFrame | None = None,
    sampled_send: DataFrame | None = None,
) -> DataFrame:
    """Every judged and reported row of a capture; ``full_report`` adds evidence and the roll-up."""
    pooled = FL.pooled_floor(conns, samples, cfg)
    floored = FL.judged_requests(ops, conns, pooled, cfg)
    cap = with_capture(op_facts(floored, cfg), ops, conns, samples, cfg, sampled_send)
    window = capture_window(ops, conns, samples)
    parts = [
        rows(cap, OP_ROWS, cfg),
        class_rows(floored, window, cfg),
        path_rows(conn_facts(conns, cfg), window),
        environment_row(conns, window, pooled, cfg),
    ]
    if series is not None:
        parts.append(series)
    return FD.union_all(parts)


def with_evidence(rows: DataFrame, ops: DataFrame, limit: int = 5) -> DataFrame:
    """The rows with the requests that they rest on, where they name any."""
    found = op_evidence(ops, limit).select(F.col("finding_id").alias("_f"), F.col("row_op").alias("_o"), F.col("evidence").alias("_e"))
    same = (F.col("finding_id") == F.col("_f")) & F.col("s3_op").eqNullSafe(F.col("_o"))
    return rows.join(found, same, "left").withColumn("evidence", F.coalesce("evidence", "_e")).drop("_f", "_o", "_e")


def run_row(rows: DataFrame, ops: DataFrame, conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The roll-up of a report: its overall verdict as one more row."""
    overall = run_verdict(rows, ops, conns, cfg).withColumn(
        "r",
        rows.agg(
            F.struct(
                F.max(F.when(F.col("finding_id") == "baseline_rtt", F.round(F.col("value_num") * 1e3))).cast("bigint").alias("floor"),
                F.max("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"),
            )
        ).scalar(),
    ).withColumn("n", conns.agg(F.count(F.lit(1))).scalar())
    return FD.emit(
        overall, finding_id="run", domain="run", title="run health", severity=F.col("severity"), verdict=F.col("verdict"), metric="verdict", unit="none",
        baseline_rtt_us=F.col("r.floor"), judged=F.col("answered") + F.col("n"), excluded=F.col("operations") - F.col("answered"), sample_kind="mixed",
        ts_start=F.col("r.ts_start"), ts_end=F.col("r.ts_end"),
    )


def full_report(
    ops: DataFrame,
    conns: DataFrame,
    samples: DataFrame,
    cfg: Config = DEFAULT,
    series: DataFrame | None = None,
    sampled_send: DataFrame | None = None,
) -> DataFrame:
    """The report with its evidence and its roll-up."""
    out = materialize(report(ops, conns, samples, cfg, series, sampled_send), "report")
    return with_evidence(out, ops, cfg.max_evidence).unionByName(run_row(out, ops, conns, cfg))


def sampled_path_rows(ceilings: DataFrame, conns: DataFrame, window: DataFrame) -> DataFrame:
    """The ceilings of in-flight samples as rows of the report, only if no connection closed: closed ones tell more.

    Each row is judged over the streams of its own direction.
    """
    f = (
        ceilings.withColumn("closed", conns.agg(F.count(F.lit(1))).scalar())
        .where(F.col("closed") == 0)
        .withColumn("w", window.select(F.struct("*")).scalar())
    )
    down = F.col("direction") == "down"
    given = dict(unit="bytes_per_s", judged=F.col("streams"), excluded=0, value_str=F.col("note"))
    return FD.emit_each(
        f,
        [
            (down, _row("recv_ceiling", "unjudged", "fyi", "recv_window_ceiling", F.col("ceiling"), **given)),
            (~down, _row("bdp_ceiling", "unjudged", "fyi", "bdp_ceiling", F.col("ceiling"), **given)),
        ],
    )


def capture_report(ops: DataFrame, conns: DataFrame, samples: DataFrame, ties: tuple[str, ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """``full_report`` with everything that in-flight samples tell: throughput, loss timing and queueing, and, where nothing closed,
    retransmits and ceilings in the place of those of connections. Samples are cut into segments once."""
    seg, stats, shapes = TS.read_series(samples, ties, cfg)
    samples = seg  # the same rows, stored
    window = capture_window(ops, conns, samples)
    series = TS.reported_rows(seg, stats, shapes, window, cfg)
    ceilings = sampled_path_rows(TS.sampled_ceilings(seg, stats, shapes, cfg), conns, window)
    return full_report(ops, conns, samples, cfg, series.unionByName(ceilings), TS.sent_in_segments(stats))


GLOBAL_ROWS = ["baseline_rtt", "dns_cold", "tcp_connect", "ttfb_new", "ttfb_reused", "retransmit_rate", "http_errors"]


def run_verdict(rows: DataFrame, ops: DataFrame, conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: verdict, severity and exit codes, from the report rows and populations."""
    fid = F.col("finding_id")
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    judged_span = fid.isin("tcp_connect", "ttfb_new", "ttfb_reused")
    agg = rows.agg(
        has(F.col("severity") == "warn").alias("attention"),
        has(F.col("severity") == "advisory").alias("advisory"),
        has((fid == "baseline_rtt")).alias("baseline"),
        has(judged_span).alias("spans"),
        has(fid == "ttfb_reused").alias("reuse_seen"),
        has(F.col("ratio_to_rtt").isNotNull() & ~fid.isin("tls_handshake")).alias("against_floor"),
    )
    pop = ops.agg(F.count(F.lit(1)).alias("total"), F.count("http_status").alias("answered"))
    v = (
        F.when(F.col("attention"), "ATTENTION")
        .when(F.col("pop.total") == 0, "NO OPERATIONS")
        .when(F.col("pop.answered") == 0, "NO RESPONSES")
        .when(F.col("mixed") & ~F.col("against_floor"), "MIXED PATHS")
        .when(~F.col("baseline"), "NO BASELINE")
        .when(~F.col("spans"), "CHECKS PASSED")
        .otherwise("HEALTHY")
    )
    out = (
        agg.withColumn("pop", pop.select(F.struct("*")).scalar())
        .withColumn("mixed", FL.multi_path(conns, cfg).scalar())
        .withColumn("verdict", v)
    )
    code = (
        F.when(F.col("verdict") == "ATTENTION", 1)
        .when(F.col("verdict").isin("NO BASELINE", "NO OPERATIONS", "NO RESPONSES", "MIXED PATHS"), 2)
        .otherwise(0)
    )
    return out.select(
        "verdict",
        F.when(code == 1, "warn").when(code == 2, "unjudged").otherwise("healthy").alias("severity"),
        F.when(F.col("verdict") == "HEALTHY", F.col("reuse_seen")).alias("reuse_working"),
        F.col("pop.total").alias("operations"),
        F.col("pop.answered").alias("answered"),
        code.alias("exit_code"),
        F.when((code == 0) & F.col("advisory"), 1).otherwise(code).alias("exit_code_strict"),
    )


def row_verdict(rows: DataFrame) -> DataFrame:
    """The verdict of the seven global rows alone."""
    g = rows.where(F.col("finding_id").isin(GLOBAL_ROWS))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    return g.agg(
        has(F.col("severity") == "warn").alias("attention"),
        has(F.col("finding_id") == "baseline_rtt").alias("baseline"),
        has(F.col("finding_id").isin("tcp_connect", "ttfb_new", "ttfb_reused")).alias("spans"),
        has(F.col("finding_id") == "ttfb_reused").alias("reuse_seen"),
    ).select(
        F.when(F.col("attention"), "ATTENTION")
        .when(~F.col("baseline"), "NO BASELINE")
        .when(~F.col("spans"), "CHECKS PASSED")
        .otherwise("HEALTHY")
        .alias("verdict"),
        F.when(~F.col("attention") & F.col("baseline") & F.col("spans"), F.col("reuse_seen")).alias("reuse_working"),
    )


def op_evidence(ops: DataFrame, limit: int = 5) -> DataFrame:
    """(finding_id, s3_op) -> the first contributing requests of the rows that name requests."""
    cls = C.status_class(F.col("http_status"))
    tags = F.array_compact(
        F.array(
            F.when(F.col("http_status") >= 400, F.struct(F.lit("http_errors").alias("finding_id"), F.lit(None).cast("string").alias("row_op"))),
            F.when(cls == "throttle", F.struct(F.lit("s3_throttle").alias("finding_id"), F.lit(None).cast("string").alias("row_op"))),
            F.when(cls == "server", F.struct(F.lit("s3_server_errors").alias("finding_id"), F.lit(None).cast("string").alias("row_op"))),
            F.when(cls.isin("forbidden", "not_found", "bad_request", "client"),
                   F.struct(F.lit("s3_client_errors").alias("finding_id"), F.lit(None).cast("string").alias("row_op"))),
            F.when(good() & F.col("s3_op").isNotNull(),
                   F.struct(F.lit("s3_ttfb").alias("finding_id"), C.sanitize_term(F.col("s3_op")).alias("row_op"))),
        )
    )
    tagged = ops.select("ts_ns", "op_id", "sock_cookie", "aws_request_id", F.explode(tags).alias("t")).select(
        "ts_ns", "op_id", "sock_cookie", "aws_request_id", "t.finding_id", "t.row_op"
    )
    return FD.evidence(tagged, ["finding_id", "row_op"], limit)
