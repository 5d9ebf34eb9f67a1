"""Usage advisories per process.

Partial requests stay in denominators and in sets that can only de-escalate; they never
enter a numerator or a timing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.operators.slices import CELL, HOME, prefix, range_halo
from tidemark.plans import findings as FD
from tidemark.plans.scorecard import capture_window
from tidemark.session import materialize


def _advisory(df: DataFrame, fid: str, severity, metric, value, unit: str, **more) -> DataFrame:
    return FD.emit(
        df, finding_id=fid, title="usage advisory", severity=severity, metric=metric, value_num=value, unit=unit,
        domain=more.pop("domain", "client"), sample_kind=more.pop("sample_kind", "operation"), **more,
    )


def _object_key() -> Column:
    """Bucket and key together; requests without a bucket share one pseudo-bucket."""
    return F.concat(C.fill_key(F.col("bucket")), F.lit("/"), F.col("key_hash"))


# -- connection churn -----------------------------------------------------------------

def churn_stats(ops: DataFrame) -> DataFrame:
    """Per process: requests, fresh connections, their connect cost and the earliest one's."""
    fresh = ~F.col("connection_reused") & ~F.col("partial")
    cost = F.coalesce("tcp_connect_ns", F.lit(0)) + F.coalesce("tls_handshake_ns", F.lit(0))
    timed = fresh & F.col("tcp_connect_ns").isNotNull()
    return ops.where(F.col("s3_op").isin("GetObject", "PutObject")).groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("partial").alias("partials"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(timed).alias("timed"),
        F.coalesce(F.sum(F.when(timed, cost)), F.lit(0)).alias("cost_ns"),
        F.coalesce(F.min_by(cost, F.when(fresh, F.struct("ts_ns", "op_id"))), F.lit(0)).alias("earliest_ns"),
        F.coalesce(F.min("ts_ns"), F.lit(0)).alias("ts_start"),
        F.coalesce(F.max("ts_ns"), F.lit(0)).alias("ts_end"),
    )


def connection_churn(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    s = churn_stats(ops).withColumn("share", F.col("fresh") / F.col("n")).where(
        (F.col("n") >= cfg.adv_min_ops) & (F.col("share") > cfg.churn_single_shot)
    )
    untimed = F.col("fresh") - F.col("timed")
    blind = untimed > cfg.churn_untimed_max * F.col("fresh")
    wasted = F.greatest(F.col("cost_ns") - F.col("earliest_ns"), F.lit(0)) / 1e6
    return _advisory(
        s.where(blind | (wasted >= cfg.churn_wasted_ms)),
        "advisor-connection-churn",
        F.when(blind, "unjudged").otherwise("advisory"),
        F.when(blind, "single_shot_frac").otherwise("wasted_connect_ms"),
        F.when(blind, F.col("share")).otherwise(wasted),
        "none",
        judged=F.col("n"), excluded=untimed + F.col("partials"), app_pid=F.col("pid"),
        ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    ).withColumn("unit", F.when(F.col("metric") == "single_shot_frac", "ratio").otherwise("ms"))


def process_per_request(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Many short-lived processes, nearly all requests on fresh connections."""
    fleet = churn_stats(ops).agg(
        F.count(F.lit(1)).alias("pids"), F.max("n").alias("largest"), F.sum("n").alias("n"), F.sum("fresh").alias("fresh"),
        F.sum("partials").alias("partials"), F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"),
    )
    share = F.col("fresh") / F.col("n")
    return _advisory(
        fleet.where(
            (F.col("largest") < cfg.adv_min_ops) & (F.col("pids") >= cfg.fleet_min_pids)
            & (F.col("fresh") >= cfg.fleet_min_fresh) & (share > cfg.fleet_single_shot)
        ),
        "advisor-connection-churn", "advisory", "single_shot_frac", share, "ratio",
        judged=F.col("n"), excluded=F.col("partials"), ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    )


# -- serial requests ------------------------------------------------------------------

def concurrency(intervals: DataFrame) -> DataFrame:
    """Per process: busy_ns with at least one socket in flight, overlap_ns with two or more.

    ``intervals``: pid, sock_cookie, ts_ns, total_ns > 0, half-open. Counts run per socket
    and then per process, both in slices; time adds up as differences of the moments at
    which a state begins and ends, so no interval has to see its successor.
    """
    ends = F.array(F.struct(F.col("ts_ns").alias("t"), F.lit(1).alias("d")), F.struct((F.col("ts_ns") + F.col("total_ns")).alias("t"), F.lit(-1).alias("d")))
    net = (
        intervals.select("pid", "sock_cookie", F.explode(ends).alias("e"))
        .groupBy("pid", "sock_cookie", F.col("e.t").alias("t"))
        .agg(F.sum("e.d").alias("d"))
        .where(F.col("d") != 0)
    )
    per_socket = prefix(net, ["pid", "sock_cookie"], "t", {"open": ("sum", F.col("d"))})
    step = (F.col("open") > 0).cast("int") - (F.col("open") - F.col("d") > 0).cast("int")
    changes = materialize(
        per_socket.groupBy("pid", "t").agg(F.sum(step).alias("d")).where(F.col("d") != 0), "socket-changes"
    )
    run = prefix(changes, ["pid"], "t", {"sockets": ("sum", F.col("d"))})

    def spent(least: int) -> Column:
        now = (F.col("sockets") >= least).cast("int")
        was = (F.col("sockets") - F.col("d") >= least).cast("int")
        return F.sum((was - now) * F.col("t").cast("decimal(20,0)")).cast("bigint")

    return run.groupBy("pid").agg(spent(1).alias("busy_ns"), spent(2).alias("overlap_ns"))


def serial_requests(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    gets = ops.where(F.col("s3_op") == "GetObject")
    judged = ~F.col("partial") & (F.col("delimitation") == "clean") & F.col("ts_ns").isNotNull() & F.col("total_ns").isNotNull()
    pop = gets.groupBy("pid").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(judged).alias("n"),
        F.coalesce(F.min("ts_ns"), F.lit(0)).alias("all_start"),
        F.coalesce(F.max("ts_ns"), F.lit(0)).alias("all_end"),
        F.min(F.when(judged, F.col("ts_ns"))).alias("ts_start"),
        F.max(F.when(judged, F.col("ts_ns"))).alias("ts_end"),
        F.max(F.when(judged, F.col("ts_ns") + F.col("total_ns"))).alias("last"),
    )
    busy = concurrency(gets.where(judged & (F.col("total_ns") > 0)))
    j = pop.join(busy, "pid", "left").where(F.col("seen") >= cfg.adv_min_ops)
    dropped = F.col("seen") - F.col("n")
    blind = dropped > cfg.max_dropped_frac * F.col("seen")
    floor = F.greatest(
        F.lit(cfg.serial_busy_floor_ns), F.floor(cfg.serial_busy_window_frac * (F.col("last") - F.col("ts_start")).cast("double"))
    )
    serial = (
        (F.col("n") >= cfg.adv_min_ops) & (F.col("busy_ns") >= floor) & (F.col("busy_ns") > 0)
        & (F.col("overlap_ns") / F.when(F.col("busy_ns") > 0, F.col("busy_ns")) < cfg.serial_overlap_ceil)
    )
    return _advisory(
        j.where(blind | F.coalesce(serial, F.lit(False))),
        "advisor-serial-requests",
        F.when(blind, "unjudged").otherwise("advisory"),
        F.when(blind, "dropped_frac").otherwise("serialized_busy_ms"),
        F.when(blind, dropped / F.col("seen")).otherwise(F.col("busy_ns") / 1e6),
        "none",
        judged=F.col("n"), excluded=dropped, app_pid=F.col("pid"),
        ts_start=F.when(blind, F.col("all_start")).otherwise(F.col("ts_start")),
        ts_end=F.when(blind, F.col("all_end")).otherwise(F.col("ts_end")),
    ).withColumn("unit", F.when(F.col("metric") == "dropped_frac", "ratio").otherwise("ms"))


# -- redundant refetch ----------------------------------------------------------------

def read_runs(ops: DataFrame) -> DataFrame:
    """(pid, object, epoch): whole-body reads between two writes of the object by anyone.

    The epoch of a read is the number of writes strictly before it, counted capture-wide in
    slices of the object's history.
    """
    write = F.col("s3_op").isin(C.WRITE_OPS)
    read = (F.col("s3_op") == "GetObject") & F.coalesce(F.col("http_status") == 200, F.lit(False)) & ~F.col("partial")
    ev = ops.where(F.col("key_hash").isNotNull() & F.col("ts_ns").isNotNull() & (write | read)).select(
        _object_key().alias("obj"), "ts_ns", "op_id", "pid", F.col("content_length").alias("size"), write.alias("is_write")
    )
    epochs = prefix(ev, ["obj"], "ts_ns", {"epoch": ("sum", F.col("is_write").cast("int"))}, frame="range_before")
    return (
        epochs.where(~F.col("is_write"))
        .groupBy("pid", "obj", "epoch")
        .agg(
            F.count(F.lit(1)).alias("reads"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
            F.count_if(F.col("size").isNull()).alias("unsized"),
            F.min(F.struct("ts_ns", "op_id", "size")).alias("first"),
            F.max("ts_ns").alias("last_ts"),
        )
        .select(
            "pid", "obj", "epoch", "reads",
            (F.col("bytes") - F.coalesce("first.size", F.lit(0))).alias("repeat_bytes"),
            (F.col("unsized") - F.col("first.size").isNull().cast("int")).alias("repeat_unsized"),
            F.col("first.ts_ns").alias("first_ts"), "last_ts",
        )
    )


def redundant_refetch(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    per_obj = read_runs(ops).groupBy("pid", "obj").agg(
        F.sum("reads").alias("gets"), F.max("reads").alias("longest"), F.sum(F.col("reads") - 1).alias("redundant"),
        F.sum("repeat_bytes").alias("bytes"), F.sum("repeat_unsized").alias("unsized"),
        F.min("first_ts").alias("ts_start"), F.max("last_ts").alias("ts_end"),
    )
    hit = F.col("longest") > cfg.refetch_repeats
    per_pid = per_obj.groupBy("pid").agg(
        F.sum("gets").alias("gets"),
        F.count_if(hit).alias("objects"),
        F.sum(F.when(hit, F.col("redundant"))).alias("redundant"),
        F.sum(F.when(hit, F.col("bytes"))).alias("bytes"),
        F.sum(F.when(hit, F.col("unsized"))).alias("unsized"),
        F.max(F.when(hit, F.struct("bytes", "redundant", "obj"))).alias("top"),
        F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"),
    )
    whole = (F.col("s3_op") == "GetObject") & F.coalesce(F.col("http_status") == 200, F.lit(False))
    write = F.col("s3_op").isin(C.WRITE_OPS)
    left_out = ops.where(F.col("key_hash").isNotNull()).groupBy("pid").agg(
        F.count_if((F.col("partial") & whole) | (F.col("ts_ns").isNull() & ((whole & ~F.col("partial")) | write))).alias("left_out")
    )
    found = per_pid.where(
        (F.col("gets") >= cfg.adv_min_ops) & (F.col("objects") > 0)
        & ((F.col("bytes") >= cfg.refetch_wasted_bytes) | (F.col("redundant") >= cfg.refetch_redundant))
    ).join(left_out, "pid", "left")
    return _advisory(
        found, "advisor-redundant-refetch", "advisory", "wasted_bytes", F.col("bytes"), "none",
        value_str=F.concat_ws(" ", F.col("objects").cast("string"), F.col("redundant").cast("string"), F.col("top.obj")),
        judged=F.col("gets"), excluded=F.col("unsized") + F.coalesce("left_out", F.lit(0)), app_pid=F.col("pid"),
        ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    )


# -- HEAD then GET --------------------------------------------------------------------

def head_claims(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per HEAD the reads it claims: each read goes to the earliest HEAD of the same process
    and object within the window before it."""
    timed = F.when(~F.col("partial") & (F.col("delimitation") == "clean"), F.col("total_ns"))
    ev = ops.where(F.col("key_hash").isNotNull() & F.col("ts_ns").isNotNull() & F.col("s3_op").isin("HeadObject", "GetObject")).select(
        "pid", _object_key().alias("obj"), "ts_ns",
        F.when(F.col("s3_op") == "HeadObject", F.struct("ts_ns", timed.alias("timed"), "op_id")).alias("head"),
    )
    w = Window.partitionBy("pid", "obj", CELL).orderBy("ts_ns").rangeBetween(-cfg.pair_window_ns, -1)
    return (
        range_halo(ev, "ts_ns", back=cfg.pair_window_ns)
        .withColumn("claim", F.min("head").over(w))
        .where(F.col(HOME) & F.col("head").isNull() & F.col("claim").isNotNull())
        .groupBy("pid", "obj", "claim")
        .agg(F.count(F.lit(1)).alias("reads"))
        .select("pid", "obj", F.col("claim.ts_ns").alias("head_ts"), F.col("claim.timed").alias("head_ns"), "reads")
    )


def head_then_get(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    pairs = head_claims(ops, cfg).where(F.col("reads") == 1).groupBy("pid").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("head_ns").isNull()).alias("untimed"),
        F.coalesce(F.sum("head_ns"), F.lit(0)).alias("wasted_ns"),
    )
    pop = ops.where(
        F.col("key_hash").isNotNull() & F.col("ts_ns").isNotNull() & F.col("s3_op").isin("HeadObject", "GetObject")
    ).groupBy("pid").agg(
        F.count(F.lit(1)).alias("both"), F.count_if(F.col("s3_op") == "GetObject").alias("gets"),
        F.min("ts_ns").alias("ts_start"), F.max("ts_ns").alias("ts_end"),
    )
    j = pairs.join(pop, "pid").where(
        (F.col("pairs") >= cfg.min_pairs) & (F.col("gets") > 0) & (F.col("pairs") / F.greatest("gets", F.lit(1)) >= cfg.pair_ratio_floor)
    )
    blind = F.col("untimed") > cfg.max_untimed_frac * F.col("pairs")
    return _advisory(
        j, "advisor-head-then-get", F.when(blind, "unjudged").otherwise("advisory"), "head_get_pairs", F.col("pairs"), "count",
        value_str=(F.col("wasted_ns") / 1e6).cast("decimal(20,3)").cast("string"),
        judged=F.col("both"), excluded=F.col("untimed"), app_pid=F.col("pid"), ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    )


# -- small objects --------------------------------------------------------------------

def small_objects(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    whole = ops.where((F.col("s3_op") == "GetObject") & (F.col("http_status") == 200))
    timed = (F.col("delimitation") == "clean") & ~F.col("partial") & F.col("ttfb_ns").isNotNull() & F.col("download_ns").isNotNull()
    pop = whole.groupBy("pid").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(timed).alias("n"),
        F.count_if(timed & F.col("content_length").isNotNull()).alias("sized"),
        F.coalesce(F.sum(F.when(timed, F.col("ttfb_ns"))), F.lit(0)).alias("ttfb"),
        F.coalesce(F.sum(F.when(timed, F.col("download_ns"))), F.lit(0)).alias("download"),
        F.coalesce(F.min("ts_ns"), F.lit(0)).alias("ts_start"), F.coalesce(F.max("ts_ns"), F.lit(0)).alias("ts_end"),
        F.coalesce(F.min(F.when(timed, F.coalesce("ts_ns", F.lit(0)))), F.lit(0)).alias("j_start"),
        F.coalesce(F.max(F.when(timed, F.coalesce("ts_ns", F.lit(0)))), F.lit(0)).alias("j_end"),
    )
    med = exact_quantiles(whole.where(timed), ["pid"], {"s": F.col("content_length")}, [Stat("median_size", "s", "upper")])
    j = pop.join(med.select("pid", "median_size"), "pid", "left").where(F.col("total") >= cfg.min_tiny_gets)
    dropped, unsized = F.col("total") - F.col("n"), F.col("n") - F.col("sized")
    blind = dropped > cfg.max_dropped_frac * F.col("total")
    enough = F.col("n") >= cfg.min_tiny_gets
    coverage = F.col("sized") / F.when(F.col("n") > 0, F.col("n"))
    dim = enough & (coverage < cfg.size_coverage_floor)
    storm = (
        enough & (F.col("median_size") <= cfg.tiny_median_ceil) & (F.col("ttfb") >= F.col("download")) & (F.col("ttfb") >= cfg.overhead_floor_ns)
    )
    state = F.when(blind, "dropped_frac").when(dim, "size_coverage").when(storm, "overhead_fraction")
    s = j.withColumn("metric", state).where(F.col("metric").isNotNull())
    m = F.col("metric")
    return _advisory(
        s, "advisor-small-objects", F.when(m == "overhead_fraction", "advisory").otherwise("unjudged"), m,
        F.when(m == "dropped_frac", dropped / F.col("total")).when(m == "size_coverage", coverage)
        .otherwise(F.col("ttfb") / F.greatest(F.col("ttfb") + F.col("download"), F.lit(1))),
        "ratio", judged=F.col("n"),
        excluded=F.when(m == "dropped_frac", dropped).when(m == "size_coverage", unsized).otherwise(dropped + unsized),
        app_pid=F.col("pid"),
        ts_start=F.when(m == "size_coverage", F.col("j_start")).otherwise(F.col("ts_start")),
        ts_end=F.when(m == "size_coverage", F.col("j_end")).otherwise(F.col("ts_end")),
    )


# -- throttling -----------------------------------------------------------------------

def throttle_recovery(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every 503 with ``recovered``: did the same process succeed on the same key (or, without
    a key, the same bucket) within the window after it? NULL when the capture ends first."""
    answered = ops.where(F.col("ts_ns").isNotNull() & F.col("http_status").isNotNull())
    end = answered.agg(F.max("ts_ns").alias("e"))
    ok = C.status_class(F.col("http_status")) == "success"
    throttled = F.col("http_status") == 503
    ev = answered.where(ok | throttled).select(
        F.coalesce(F.col("pid").cast("bigint"), F.lit(-1)).alias("p"), C.fill_key(F.col("bucket")).alias("b"), "ts_ns", "op_id", "pid", throttled.alias("throttled"),
        F.when(F.col("key_hash").isNotNull(), C.fill_key(F.col("key_hash"))).otherwise("*").alias("link"), (-F.col("ts_ns")).alias("back"),
    )
    # a success serves waiters on its key; on its whole bucket only where some 503 has no key
    waiting = ev.where(F.col("throttled") & (F.col("link") == "*")).select("p", "b").distinct()
    whole = ev.where(~F.col("throttled") & (F.col("link") != "*")).join(waiting, ["p", "b"], "left_semi").withColumn("link", F.lit("*"))
    # in reversed time the next success is a running maximum, however busy the process
    nxt = prefix(
        ev.unionByName(whole), ["p", "b", "link"], "back", {"next": ("max", F.when(~F.col("throttled"), F.col("back")))}, frame="range_before"
    ).where("throttled")
    return nxt.withColumn("_end", end.scalar()).select(
        "op_id", "pid", "ts_ns",
        F.when(F.col("ts_ns") + cfg.recovery_window_ns <= F.col("_end"), F.coalesce(-F.col("next") - F.col("ts_ns") <= cfg.recovery_window_ns, F.lit(False))).alias("recovered"),
    )


def throttling(ops: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    answered = F.col("ts_ns").isNotNull() & F.col("http_status").isNotNull()
    pop = ops.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(answered).alias("n"), F.count_if(answered & (F.col("http_status") == 503)).alias("throttled"),
        F.min(F.when(answered, F.col("ts_ns"))).alias("ts_start"), F.max(F.when(answered, F.col("ts_ns"))).alias("ts_end"),
    )
    rec = throttle_recovery(ops, cfg).agg(
        F.count_if(F.col("recovered")).alias("yes"), F.count_if(~F.col("recovered")).alias("no"), F.count_if(F.col("recovered").isNull()).alias("open")
    )
    rate = F.col("throttled") / F.when(F.col("n") > 0, F.col("n"))
    s = pop.where((F.col("n") >= cfg.adv_min_ops) & (F.col("throttled") >= cfg.throttle_min) & (rate > cfg.throttle_rate_floor)).withColumn(
        "r", rec.select(F.struct("*")).scalar()
    )
    return _advisory(
        s, "advisor-throttling", F.when(F.col("r.no") > 0, "warn").when(F.col("r.yes") > 0, "advisory").otherwise("unjudged"),
        "rate_503", rate, "ratio", domain="s3",
        value_str=F.concat_ws("/", F.col("r.yes").cast("string"), F.col("r.no").cast("string"), F.col("r.open").cast("string")),
        judged=F.col("n"), excluded=F.col("seen") - F.col("n"), ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    )


# -- network path ---------------------------------------------------------------------

def latency_path(conns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per endpoint address: cross-region access, a high floor, or a path nothing can judge."""
    c = conns.withColumn("ip", F.coalesce("endpoint_ip", F.lit("unknown")))
    rtt = C.usable_rtt(F.col("min_rtt_us"), cfg)
    g = c.groupBy("ip").agg(
        F.count(F.lit(1)).alias("n"), F.count(rtt).alias("usable"), F.max("cross_region").alias("cross"), F.max("via_vpce").alias("vpce"),
        F.min("pid").alias("p0"), F.max("pid").alias("p1"),
        F.min_by("region", F.when(F.col("region").isNotNull(), F.struct("ts_ns", "sock_cookie"))).alias("region"),
        F.coalesce(F.min("ts_ns"), F.lit(0)).alias("ts_start"), F.coalesce(F.max("ts_ns"), F.lit(0)).alias("ts_end"),
    )
    med = exact_quantiles(c, ["ip"], {"r": rtt}, [Stat("median_us", "r", "upper")]).select("ip", "median_us")
    few = F.col("usable") < cfg.path_min_conns
    high = ~few & (F.col("median_us") >= cfg.rtt_report_floor_us)
    kind = (
        F.when(F.col("cross"), "cross")
        .when(few & (F.col("n") >= cfg.path_min_conns), "blind")
        .when(high & F.col("vpce"), "vpce")
        .when(high, "high")
    )
    s = g.join(med, "ip", "left").withColumn("kind", kind).where(F.col("kind").isNotNull())
    k = F.col("kind")
    return _advisory(
        s,
        F.when(k == "cross", "advisor-latency-cross-region").when(k == "high", "advisor-latency-high-rtt").otherwise("advisor-latency-unjudged"),
        F.when(k == "cross", "advisory").otherwise("unjudged"),
        F.when(k == "cross", "connections").when(k == "blind", "rtt_samples").otherwise("median_min_rtt_us"),
        F.when(k == "cross", F.col("n")).when(k == "blind", F.col("usable")).otherwise(F.col("median_us")),
        "count", domain="network", sample_kind="connection", value_str=F.col("ip"),
        judged=F.when(k == "cross", F.col("n")).otherwise(F.col("usable")),
        excluded=F.when(k == "cross", 0).otherwise(F.col("n") - F.col("usable")),
        region=F.when(k == "cross", F.col("region")), app_pid=F.when(F.col("p0") == F.col("p1"), F.col("p0")),
        ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
    ).withColumn("unit", F.when(F.col("metric") == "median_min_rtt_us", "us").otherwise("count"))


# -- all checks -----------------------------------------------------------------------

CHECKS = {
    "connection_churn": lambda ops, conns, cfg: connection_churn(ops, cfg),
    "process_per_request": lambda ops, conns, cfg: process_per_request(ops, cfg),
    "serial_requests": lambda ops, conns, cfg: serial_requests(ops, cfg),
    "redundant_refetch": lambda ops, conns, cfg: redundant_refetch(ops, cfg),
    "head_then_get": lambda ops, conns, cfg: head_then_get(ops, cfg),
    "small_objects": lambda ops, conns, cfg: small_objects(ops, cfg),
    "throttling": lambda ops, conns, cfg: throttling(ops, cfg),
    "latency_path": lambda ops, conns, cfg: latency_path(conns, cfg),
}


def advise(ops: DataFrame, conns: DataFrame, cfg: Config = DEFAULT, extra: list[DataFrame] = ()) -> DataFrame:
    """Every check's findings; ``extra`` takes findings of the cache study."""
    return FD.union_all([check(ops, conns, cfg) for check in CHECKS.values()] + list(extra))


def run_row(ops: DataFrame, conns: DataFrame) -> DataFrame:
    """One unjudged row when there was nothing a check could have judged."""
    pop = ops.agg(F.count(F.lit(1)).alias("seen"), F.count("http_status").alias("answered")).withColumn(
        "w", capture_window(ops, conns).select(F.struct("*")).scalar()
    )
    return _advisory(
        pop.where((F.col("seen") == 0) | (F.col("answered") == 0)), "advisor-run", "unjudged", "judgeable_operations",
        F.col("answered"), "count", domain="run", judged=F.col("answered"), excluded=F.col("seen") - F.col("answered"),
        ts_start=F.col("w.ts_start"), ts_end=F.col("w.ts_end"),
    )


def gate(findings: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: findings by severity and the exit codes, plain and strict."""
    pop = ops.agg(F.count(F.lit(1)).alias("seen"), F.count("http_status").alias("answered"))
    sev = F.col("severity")
    return (
        findings.agg(
            F.count(F.lit(1)).alias("findings"), F.count_if(sev.isin("warn", "advisory")).alias("raised"), F.count_if(sev == "unjudged").alias("unjudged")
        )
        .withColumn("p", pop.select(F.struct("*")).scalar())
        .withColumn("exit_code", F.when((F.col("p.seen") == 0) | (F.col("p.answered") == 0), 2).otherwise(0))
        .withColumn("exit_code_strict", F.when(F.col("raised") > 0, 1).otherwise(F.col("exit_code")))
        .select("findings", "raised", "unjudged", F.col("p.seen").alias("operations"), F.col("p.answered").alias("answered"), "exit_code", "exit_code_strict")
    )
