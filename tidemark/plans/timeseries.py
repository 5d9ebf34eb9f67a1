"""In-flight samples: counter segments, rates, shape, loss timing and queueing.

Sockets are cut into slices throughout (see ``operators.slices``); per-segment results
come from partial aggregation, so one long-lived socket does not own a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions import columns as C
from tidemark.operators.quantiles import Stat, exact_quantiles
from tidemark.operators.slices import SLICE, lagged, prefix, uncut, with_slices
from tidemark.plans import findings as FD
from tidemark.session import materialize

SEG = ["sock_cookie", "seg"]


#: What the rows of ``segments`` know of their whole segment, where sockets fit a task.
KNOWN = ("_direction", "_t0", "_t1", "_floor_us", "_n_rates", "_peak", "_s", "_e")


def known(df: DataFrame) -> bool:
    """Whether rows carry ``KNOWN``, so that the sums of segments need not be joined to them."""
    return set(KNOWN) <= set(df.columns)


def segments(samples: DataFrame, ties: tuple[str, ...] = (), cfg: Config = DEFAULT, store: bool = True) -> DataFrame:
    """Samples with ``seg`` (a new one whenever a byte counter falls) and ``prev_*`` columns,
    which are NULL on the first sample of a segment. The result is stored once, as most later
    steps read it several times; without ``store`` only where sockets had to be cut.

    Where no socket has to be cut, the same tasks add what the later steps would join to every row (``KNOWN``); of what is stored then, the
    rows of a socket lie together, so that later sums by segment are all but done before they are shuffled."""
    cols = ("ts_ns", "bytes_recv", "bytes_sent", "total_retrans", "rcv_ooopack")
    sliced = samples if SLICE in samples.columns else with_slices(samples, "ts_ns", keys=["sock_cookie"])
    if not uncut(sliced):
        sliced = materialize(sliced, "samples")
    prev = lagged(sliced, ["sock_cookie"], "ts_ns", {f"prev_{c}": (c, 1) for c in cols}, ties=ties)
    reset = (F.col("bytes_recv") < F.col("prev_bytes_recv")) | (F.col("bytes_sent") < F.col("prev_bytes_sent"))
    flagged = prev.withColumn("_reset", F.coalesce(reset, F.lit(False)))
    out = prefix(flagged, ["sock_cookie"], "ts_ns", {"seg": ("sum", F.col("_reset").cast("int"))}, ties=ties).select(
        *[c for c in samples.columns if c != SLICE],
        SLICE,
        "seg",
        *[F.when(~F.col("_reset"), F.col(f"prev_{c}")).alias(f"prev_{c}") for c in cols],
    )
    if uncut(sliced):
        out = _with_known(out, ties, cfg)
    return materialize(out, "segments") if store or not uncut(sliced) else out


def _with_known(seg: DataFrame, ties: tuple[str, ...], cfg: Config) -> DataFrame:
    """Samples with ``KNOWN``, by windows over whole segments in one order."""
    ordered = Window.partitionBy(*SEG).orderBy("ts_ns", *ties)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c: c.over(whole)
    at = ", ".join(("ts_ns", *ties))
    ahead = lambda c, k: F.expr(f"lead({c}, {k}) IGNORE NULLS OVER (PARTITION BY sock_cookie, seg ORDER BY {at})")
    three = lambda c: (F.col(c) + ahead(c, 1) + ahead(c, 2)) / 3.0
    optional = lambda name, kind: F.col(name) if name in seg.columns else F.lit(None).cast(kind)
    d = seg.withColumns({f"_{x}": _interval(F.lit(x), F.lit(0), optional("delivery_rate_bps", "bigint"))[1] for x in ("down", "up")})
    d = d.select(
        "*", over(F.max("bytes_sent")).alias("last_sent"), over(F.max("bytes_recv")).alias("last_recv"),
        over(F.min("ts_ns")).alias("_t0"), over(F.max("ts_ns")).alias("_t1"),
        over(F.min(C.usable_rtt(optional("min_rtt_us", "bigint"), cfg))).alias("_floor_us"), three("_down").alias("_down3"), three("_up").alias("_up3"),
    ).withColumn("_direction", _direction(cfg))
    t, rate = _interval(F.col("_direction"), F.col("_t0"), optional("delivery_rate_bps", "bigint"))
    mean = F.when(F.col("_direction") == "down", F.col("_down3")).when(F.col("_direction") == "up", F.col("_up3"))
    d = d.select("*", t.alias("_t"), rate.alias("_rate"), mean.alias("_mean"))
    n = over(F.count("_rate"))
    d = d.select("*", n.alias("_n_rates"), F.when(n < 3, over(F.max("_rate"))).otherwise(over(F.max("_mean"))).alias("_peak"))
    active = F.when(F.col("_rate") >= cfg.ts_idle_frac * F.col("_peak"), F.col("_t"))
    return d.select(*seg.columns, *KNOWN[:-2], over(F.min(active)).alias("_s"), over(F.max(active)).alias("_e"))


def _direction(cfg: Config) -> Column:
    up = (F.col("last_sent") > F.col("last_recv")) & (F.col("last_sent") >= cfg.min_directional_bytes)
    down = (F.col("last_recv") > F.col("last_sent")) & (F.col("last_recv") >= cfg.min_directional_bytes)
    return F.when(up, "up").when(down, "down")


def _interval(direction: Column, start: Column, delivery: Column) -> tuple[Column, Column]:
    """(t, rate) of a sample of a segment with this direction and start; null where it has no direction."""
    ts, prev, t0 = (c.cast("double") for c in (F.col("ts_ns"), F.col("prev_ts_ns"), start))
    dt = F.col("ts_ns") - F.col("prev_ts_ns")
    down, up = direction == "down", direction == "up"
    rate = F.when(down, F.when(dt > 0, (F.col("bytes_recv") - F.col("prev_bytes_recv")).cast("double") / (dt / 1e9))).when(up, delivery.cast("double"))
    return F.when(down, (prev + ts) / 2.0 - t0).when(up, ts - t0), rate


def segment_stats(seg: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per segment: span, byte and retransmit deltas, direction, RTT floor."""
    first = lambda c: F.min_by(c, "ts_ns")
    last = lambda c: F.max_by(c, "ts_ns")
    floor = C.usable_rtt(F.col("min_rtt_us"), cfg)
    # byte counters never fall inside a segment, so their extremes are its first and last values
    return (
        seg.groupBy(*SEG)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts_ns").alias("t0"),
            F.max("ts_ns").alias("t1"),
            F.min("bytes_sent").alias("first_sent"),
            F.max("bytes_sent").alias("last_sent"),
            F.max("bytes_recv").alias("last_recv"),
            F.greatest(last("total_retrans") - first("total_retrans"), F.lit(0)).alias("retrans"),
            F.min(floor).alias("floor_us"),
            F.max(F.when(F.col("rcv_wnd") > 0, F.col("rcv_wnd"))).alias("max_rcv_wnd"),
        )
        .withColumn("sent", F.col("last_sent") - F.col("first_sent"))
        .withColumn("direction", _direction(cfg))
    )


def send_deltas(seg: DataFrame) -> DataFrame:
    """One row: bytes and retransmits sent within segments, and the sockets that moved."""
    return sent_in_segments(segment_stats(seg))


def sent_in_segments(stats: DataFrame) -> DataFrame:
    """``send_deltas`` from segments already summed up."""
    moved = (F.col("sent") > 0) | (F.col("retrans") > 0)
    return stats.agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.sum("retrans"), F.lit(0)).alias("retrans"),
        F.count_distinct(F.when(moved, F.col("sock_cookie"))).alias("streams"),
    )


def _with_stats(seg: DataFrame, stats: DataFrame, where: str, *cols: str) -> DataFrame:
    """Samples of the segments of which ``where`` is true, with these columns of their sums."""
    if not known(seg):
        return seg.join(stats.where(where).select(*SEG, *cols), SEG)
    named = seg.where(F.col("sock_cookie").isNotNull()).withColumns({c: F.col(f"_{c}") for c in ("direction", "t0", "t1", "floor_us")})
    return named.where(where)


def interval_rates(seg: DataFrame, stats: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """(segment, t, rate): received bytes over the interval at its midpoint for downloads,
    the sampled delivery rate for uploads; t counts from the segment start."""
    s = _with_stats(seg, stats, "direction IS NOT NULL", "direction", "t0")
    t, rate = _interval(F.col("direction"), F.col("t0"), F.col("delivery_rate_bps"))
    told = [c for c in KNOWN if c in s.columns]
    return s.select(*SEG, SLICE, "ts_ns", *ties, "direction", t.alias("t"), rate.alias("rate"), *told).where(F.col("rate").isNotNull())


def robust_peaks(rates: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Per segment the best three-interval moving mean (the plain maximum below three)."""
    if known(rates):
        return rates.groupBy(*SEG).agg(F.max("_n_rates").alias("n_rates"), F.max("_peak").alias("peak"))
    three = lagged(rates, SEG, "ts_ns", {"r1": ("rate", -1), "r2": ("rate", -2)}, ties=ties)
    mean = (F.col("rate") + F.col("r1") + F.col("r2")) / 3.0
    return three.groupBy(*SEG).agg(
        F.count(F.lit(1)).alias("n_rates"),
        F.when(F.count(F.lit(1)) < 3, F.max("rate")).otherwise(F.max(mean)).alias("peak"),
    )


def sustained_rates(rates: DataFrame, peaks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per segment the median of the rates that are not idle against its peak."""
    if known(rates):
        return rates.groupBy(*SEG).agg(F.max("_n_rates").alias("n_rates"), F.max("_peak").alias("peak"), _sustained(cfg).alias("sustained"))
    active = rates.join(peaks, SEG).where(F.col("rate") >= cfg.ts_idle_frac * F.col("peak"))
    mids = exact_quantiles(active, SEG, {"r": F.col("rate")}, [Stat("sustained", "r", "mid")])
    return peaks.join(mids.select(*SEG, "sustained"), SEG, "left").withColumn("sustained", F.coalesce("sustained", "peak"))


def _sustained(cfg: Config) -> Column:
    """``sustained`` as an aggregate over the rates of a segment that fits a task."""
    active = F.when(F.col("rate") >= cfg.ts_idle_frac * F.col("_peak"), F.col("rate"))
    return F.coalesce(F.percentile(active, 0.5), F.max("_peak"))


def _third(rel: Column) -> Column:
    return F.when(rel < 1.0 / 3.0, 0).when(rel < 2.0 / 3.0, 1).otherwise(2)


def throughput_shapes(seg: DataFrame, stats: DataFrame, ties: tuple[str, ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """One row per directional segment: sustained and peak rate, shape, time to 90 % of peak,
    loss by thirds of the active window, and whether the sender went idle at the end."""
    if known(seg):
        return _shaped(_shapes_at_once(seg, cfg), cfg)
    rates = materialize(interval_rates(seg, stats, ties), "rates")
    base = materialize(sustained_rates(rates, materialize(robust_peaks(rates, ties), "peaks"), cfg), "sustained")
    idle = cfg.ts_idle_frac * F.col("peak")
    window = (
        rates.join(base, SEG)
        .groupBy(*SEG, "direction", "n_rates", "peak", "sustained")
        .agg(F.min(F.when(F.col("rate") >= idle, F.col("t"))).alias("s"), F.max(F.when(F.col("rate") >= idle, F.col("t"))).alias("e"))
        .withColumn("aw", F.col("e") - F.col("s"))
        .withColumn("judgeable", _judgeable(cfg))
    )
    aw = F.col("aw")
    shape = (
        rates.join(window.drop("direction"), SEG)
        .groupBy(*SEG)
        .agg(*_course())
    )
    w = materialize(window.join(shape, SEG), "windows")
    joined = seg.join(stats.select(*SEG, "t0", "t1"), SEG).join(w.select(*SEG, "direction", "s", "e", "aw", "judgeable"), SEG)
    return _shaped(w.join(joined.groupBy(*SEG).agg(*_events()), SEG), cfg)


def _shapes_at_once(seg: DataFrame, cfg: Config) -> DataFrame:
    """What ``throughput_shapes`` judges by, in one aggregate over samples that know their segment."""
    s = _with_stats(seg, seg, "direction IS NOT NULL AND _n_rates > 0")
    t, rate = _interval(F.col("direction"), F.col("t0"), F.col("delivery_rate_bps"))
    s = s.withColumns({"t": t, "rate": rate, "n_rates": F.col("_n_rates"), "peak": F.col("_peak"), "s": F.col("_s"), "e": F.col("_e")})
    s = s.withColumn("aw", F.col("e") - F.col("s")).withColumn("judgeable", _judgeable(cfg))
    return s.groupBy(*SEG).agg(*[F.max(c).alias(c) for c in ("direction", "n_rates", "peak", "judgeable")], _sustained(cfg).alias("sustained"), *_course(), *_events())


def _judgeable(cfg: Config) -> Column:
    return (F.col("n_rates") >= cfg.min_ts_intervals) & (F.col("aw") > 0) & (F.col("peak") > 0)


def _course() -> list[Column]:
    """How a segment's rates run within its active window."""
    rel, aw = F.col("t") - F.col("s"), F.col("aw")
    inside = F.col("judgeable") & (F.col("t") >= F.col("s")) & (F.col("t") <= F.col("e"))
    part = lambda lo, hi: F.avg(F.when(inside & (rel >= lo) & (rel <= hi), F.col("rate")))
    return [
        part(aw / 3.0, aw * 2.0 / 3.0).alias("middle"),
        part(aw * 2.0 / 3.0, aw).alias("last"),
        F.min(F.when(inside & (F.col("rate") >= 0.9 * F.col("peak")), rel / F.when(aw > 0, aw) * 100.0)).alias("t90_pct"),
    ]


def _events() -> list[Column]:
    """Losses of a segment by thirds of its active window, and whether its sender went idle at the end."""
    middle = (F.col("prev_ts_ns").cast("double") + F.col("ts_ns").cast("double")) / 2.0 - F.col("t0").cast("double")
    late = (F.col("ts_ns").cast("double") - F.col("t0").cast("double")) >= 2.0 / 3.0 * (F.col("t1").cast("double") - F.col("t0").cast("double"))
    lost = F.greatest(
        F.when(F.col("direction") == "down", F.col("rcv_ooopack") - F.col("prev_rcv_ooopack")).otherwise(
            F.col("total_retrans") - F.col("prev_total_retrans")
        ),
        F.lit(0),
    )
    third = _third((middle - F.col("s")) / F.when(F.col("aw") > 0, F.col("aw")))
    in_window = F.col("judgeable") & (middle >= F.col("s")) & (middle <= F.col("e"))
    return [
        *[F.coalesce(F.sum(F.when(in_window & (third == i), lost)), F.lit(0)).alias(f"loss_{i}") for i in range(3)],
        F.coalesce(
            F.max((F.col("direction") == "up") & (F.col("t1") > F.col("t0")) & F.col("rate_app_limited") & late), F.lit(False)
        ).alias("app_limited"),
    ]


def _shaped(w: DataFrame, cfg: Config) -> DataFrame:
    rising = (F.col("middle") > 0) & (F.col("last") > cfg.ts_ramp_margin * F.col("middle"))
    return (
        w.withColumn(
            "shape",
            F.when(~F.col("judgeable"), "short")
            .when(F.coalesce(rising, F.lit(False)), "ramping")
            .when(F.col("sustained") >= cfg.ts_held_fraction * F.col("peak"), "steady")
            .otherwise("bursty"),
        )
        .select(*SEG, "direction", "n_rates", "peak", "sustained", "shape", "t90_pct", "app_limited", "judgeable", "loss_0", "loss_1", "loss_2")
    )


def queueing(seg: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per segment the worst srtt over its own floor, and the third where it first doubled."""
    srtt = C.usable_rtt(F.col("srtt_us"), cfg)
    ratio = srtt / F.col("floor_us")
    span = F.greatest(F.col("t1").cast("double") - F.col("t0").cast("double"), F.lit(1.0))
    third = _third((F.col("ts_ns").cast("double") - F.col("t0").cast("double")) / span)
    return (
        _with_stats(seg, stats, "floor_us > 0", "t0", "t1", "floor_us")
        .groupBy(*SEG)
        .agg(
            F.max(ratio).alias("worst_ratio"),
            F.min_by(third, F.when(ratio >= cfg.ts_bloat_hi, F.col("ts_ns"))).alias("onset"),
        )
        .where(F.col("worst_ratio").isNotNull())
    )


def aggregate_buckets(seg: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(direction, bucket, buckets): every interval's bytes spread over one-second buckets by overlap, as stretches
    of ``buckets`` equal buckets that begin at ``bucket``.

    An interval gives rows for its first and last bucket alone. The buckets between carry its full rate: a
    +rate where they begin and a -rate where they end, summed up along the bucket axis (as decimals, so nothing is left
    over when all have ended). So an interval of days costs as much as one of a second, and none is left out. A socket's intervals do not overlap, so one that
    covers a bucket in full has no edge there, and sockets add up the same way.
    """
    w = cfg.agg_bucket_ns
    s = _with_stats(seg, stats, "direction IS NOT NULL", "direction")
    moved = F.greatest(
        F.when(F.col("direction") == "down", F.col("bytes_recv") - F.col("prev_bytes_recv")).otherwise(
            F.col("bytes_sent") - F.col("prev_bytes_sent")
        ),
        F.lit(0),
    )
    iv = (
        s.where(F.col("ts_ns") > F.col("prev_ts_ns"))
        .select("sock_cookie", "direction", F.col("prev_ts_ns").alias("ta"), F.col("ts_ns").alias("tb"), moved.cast("double").alias("bytes"))
        .withColumn("b0", F.expr(f"ta div {w}L"))
        .withColumn("b1", F.expr(f"(tb - 1) div {w}L"))
    )
    part = lambda lo, hi: F.col("bytes") * (hi - lo) / (F.col("tb") - F.col("ta"))
    row = lambda bucket, bytes_, lo, hi: F.struct(bucket.alias("bucket"), bytes_.alias("bytes"), lo.alias("lo"), hi.alias("hi"))
    first_end = F.least(F.col("tb"), (F.col("b0") + 1) * w)
    last_start = F.col("b1") * w
    edges = F.array_compact(
        F.array(
            row(F.col("b0"), part(F.col("ta"), first_end), F.col("ta"), first_end),
            F.when(F.col("b1") > F.col("b0"), row(F.col("b1"), part(last_start, F.col("tb")), last_start, F.col("tb"))),
        )
    )
    # sockets first, so that counting them needs no distinct over a hot bucket
    per_socket = (
        iv.select("sock_cookie", "direction", F.explode(edges).alias("e"))
        .select("sock_cookie", "direction", "e.*")
        .groupBy("direction", "bucket", "sock_cookie")
        .agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    edge = per_socket.groupBy("direction", "bucket").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("sockets"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    inner = iv.where(F.col("b1") > F.col("b0") + 1).select(
        "direction", "b0", "b1", (F.col("bytes") * w / (F.col("tb") - F.col("ta"))).cast("decimal(38,6)").alias("rate")
    )
    step = lambda bucket, n, r: F.struct(bucket.alias("bucket"), F.lit(n).cast("bigint").alias("n"), r.alias("r"))
    steps = (
        inner.select("direction", F.explode(F.array(step(F.col("b0") + 1, 1, F.col("rate")), step(F.col("b1"), -1, -F.col("rate")))).alias("e"))
        .groupBy("direction", F.col("e.bucket").alias("bucket"))
        .agg(F.sum("e.n").alias("n"), F.sum("e.r").cast("decimal(38,6)").alias("r"))
    )
    # an edge differs from what follows it, so the bucket after it is a mark too
    marks = edge.select("direction", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket")).unionByName(steps.select("direction", "bucket")).distinct()
    running = prefix(
        materialize(marks.join(steps, ["direction", "bucket"], "left"), "marks"),
        ["direction"],
        "bucket",
        {"full": ("sum", F.coalesce("n", F.lit(0))), "full_bytes": ("sum", F.coalesce("r", F.lit(0).cast("decimal(38,6)")))},
        frame="range_upto",
    ).select("direction", "bucket", "full", "full_bytes", SLICE)
    stretches = lagged(running, ["direction"], "bucket", {"next": ("bucket", -1)}).drop(SLICE)
    whole = F.col("full") > 0
    return (
        stretches.join(edge, ["direction", "bucket"], "left")
        .select(
            "direction",
            "bucket",
            F.coalesce(F.col("next") - F.col("bucket"), F.lit(1).cast("bigint")).alias("buckets"),
            (F.coalesce("bytes", F.lit(0.0)) + F.col("full_bytes").cast("double")).alias("bytes"),
            (F.coalesce("sockets", F.lit(0)) + F.col("full")).alias("sockets"),
            F.when(whole, F.col("bucket") * w).otherwise(F.col("lo")).alias("lo"),
            F.when(whole, (F.col("bucket") + 1) * w).otherwise(F.col("hi")).alias("hi"),
        )
        .where(F.col("sockets") > 0)
        .withColumn("covered_s", (F.col("hi") - F.col("lo")) / 1e9)
        .where(F.col("covered_s") >= cfg.agg_min_cover * w / 1e9)
        .withColumn("rate", F.col("bytes") / F.col("covered_s"))
        .select("direction", "bucket", "buckets", "bytes", "sockets", "covered_s", "rate")
    )


def aggregate_throughput(buckets: DataFrame) -> DataFrame:
    """Per direction the peak and median total rate, where at least two sockets overlapped.

    The median is over buckets: a stretch counts as often as it has buckets.
    """
    buckets = materialize(buckets.select("direction", "rate", "buckets", "sockets"), "buckets")
    top = buckets.groupBy("direction").agg(F.max("rate").alias("peak"), F.max("sockets").alias("max_sockets"), F.sum("buckets").alias("n"))
    upto = prefix(buckets.drop("sockets"), ["direction"], "rate", {"c": ("sum", F.col("buckets"))}, frame="range_upto").select("direction", "rate", "c")
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    mids = (
        upto.join(top.select("direction", "n"), "direction")
        .groupBy("direction")
        .agg(((F.min(F.when(F.col("c") >= low, F.col("rate"))) + F.min(F.when(F.col("c") >= high, F.col("rate")))) / 2).alias("typical"))
    )
    return top.drop("n").join(mids, "direction").where(F.col("max_sockets") >= 2)


def ramp_summary(shapes: DataFrame) -> DataFrame:
    """One row over all segments: median sustained and peak rates, shape tallies."""
    mids = exact_quantiles(
        shapes, [], {"s": F.col("sustained"), "p": F.col("peak"), "t": F.col("t90_pct")},
        [Stat("sustained", "s", "mid"), Stat("peak", "p", "mid"), Stat("t90_pct", "t", "mid")],
    )
    tally = shapes.agg(
        F.count(F.lit(1)).alias("streams"),
        F.count_if(F.col("direction") == "down").alias("downloads"),
        F.count_if(F.col("direction") == "up").alias("uploads"),
        *[F.count_if(F.col("shape") == s).alias(s) for s in ("steady", "bursty", "ramping", "short")],
        F.count_if("app_limited").alias("app_limited"),
        *[
            F.coalesce(F.sum(F.when(F.col("judgeable") & (F.col("direction") == d), F.col(f"loss_{i}"))), F.lit(0)).alias(f"{d}_loss_{i}")
            for d in ("down", "up")
            for i in range(3)
        ],
    )
    return (
        tally.withColumn("q", mids.select(F.struct("sustained", "peak", "t90_pct")).scalar())
        .select("*", F.col("q.sustained").alias("sustained"), F.greatest("q.peak", "q.sustained").alias("peak"), F.col("q.t90_pct").alias("t90_pct"))
        .drop("q")
    )


def loss_timeline(summary: DataFrame) -> DataFrame:
    """Per direction the lost packets by thirds and where they concentrate."""
    rows = []
    for d in ("down", "up"):
        l0, l1, l2 = (F.col(f"{d}_loss_{i}") for i in range(3))
        total, top = l0 + l1 + l2, F.greatest(l0, l1, l2)
        phase = F.when(l2 == top, "late").when(l1 == top, "mid").otherwise("early")
        rows.append(
            F.when(
                total > 0,
                F.struct(
                    F.lit(d).alias("direction"), total.cast("bigint").alias("events"),
                    F.when(top > 0.5 * total, phase).otherwise("spread").alias("phase"),
                ),
            )
        )
    return summary.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")


def worst_queueing(bloat: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: the worst segment; ties go to the lowest socket and segment."""
    phases = F.array(F.lit("early"), F.lit("mid"), F.lit("late"))
    r = F.col("w.worst_ratio")
    first = F.min(F.struct((-F.col("worst_ratio")).alias("_neg"), *SEG, "worst_ratio", "onset"))
    return (
        bloat.agg(first.alias("w"))
        .where(F.col("w").isNotNull())
        .select(
            r.alias("ratio"),
            F.when(r >= cfg.ts_bloat_hi, phases[F.col("w.onset")]).alias("onset"),
            F.when(r >= cfg.ts_bloat_hi, "bloated").when(r > cfg.ts_bloat_lo, "mild").otherwise("flat").alias("verdict"),
        )
    )


def sampled_ceilings(seg: DataFrame, stats: DataFrame, shapes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Window ceilings per direction from in-flight samples, for captures in which nothing closed.

    Downloads: peak receive window over the RTT floor; uploads: median cwnd x MSS over it.
    The medians are over segments whose throughput is known, or over all when none is.
    """
    window_size = F.when(F.col("snd_cwnd") > 0, F.col("snd_cwnd"))
    if known(seg):
        cwnd = seg.groupBy(*SEG).agg(F.percentile(window_size, 0.5).alias("cwnd"))
    else:
        cwnd = exact_quantiles(seg, SEG, {"c": window_size}, [Stat("cwnd", "c", "mid")]).select(*SEG, "cwnd")
    s = (
        stats.where((F.col("floor_us") > 0) & F.col("direction").isNotNull())
        .join(cwnd, SEG, "left")
        .join(shapes.select(*SEG, "sustained", "app_limited"), SEG, "left")
    )
    rtt = F.col("floor_us") / 1e6
    s = s.withColumn(
        "ceiling",
        F.when(F.col("direction") == "down", F.col("max_rcv_wnd") / rtt).otherwise(F.col("cwnd") * float(cfg.mss_bytes) / rtt),
    ).where(F.col("ceiling").isNotNull())
    measured = F.col("sustained").isNotNull()
    mids = exact_quantiles(
        s,
        ["direction"],
        {"all": F.col("ceiling"), "k": F.when(measured, F.col("ceiling")), "r": F.col("sustained")},
        [Stat("ceiling_all", "all", "mid"), Stat("ceiling_known", "k", "mid"), Stat("achieved", "r", "mid")],
    )
    tally = s.groupBy("direction").agg(
        F.count_distinct("sock_cookie").alias("streams"),
        F.count_if(F.coalesce("app_limited", F.lit(False)) & (F.col("sustained") < 0.5 * F.col("ceiling"))).alias("app_limited"),
    )
    out = mids.join(tally, "direction").withColumn("ceiling", F.coalesce("ceiling_known", "ceiling_all"))
    ratio = F.col("achieved") / F.col("ceiling")
    return out.select(
        "direction", "ceiling", "achieved", "streams", "app_limited",
        F.when(F.col("achieved").isNull(), "not measured")
        .when((F.col("direction") == "down") & (ratio >= 0.7), "receive-window-limited")
        .when(F.col("direction") == "down", "under-ceiling")
        .when((ratio < 0.5) & (F.col("app_limited") > 0), "app-limited")
        .when(ratio < 0.5, "under-ceiling")
        .otherwise("near-ceiling")
        .alias("note"),
    )


def series_rows(samples: DataFrame, window: DataFrame, ties: tuple[str, ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """The reported rows about throughput, loss timing and queueing as findings."""
    return reported_rows(*read_series(samples, ties, cfg), window, cfg)


def read_series(samples: DataFrame, ties: tuple[str, ...] = (), cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, their sums, their shapes), each stored: what every row about samples is made of."""
    seg = segments(samples, ties, cfg)
    stats = materialize(segment_stats(seg, cfg), "segment-stats")
    return seg, stats, materialize(throughput_shapes(seg, stats, ties, cfg), "shapes")


def reported_rows(seg: DataFrame, stats: DataFrame, shapes: DataFrame, window: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``series_rows`` from samples already read."""
    summary = materialize(ramp_summary(shapes), "ramp")
    w = window.select(F.struct("*")).scalar()
    base = dict(
        domain="network", severity="unjudged", excluded=0, sample_kind="connection",
        ts_start=F.col("w.ts_start"), ts_end=F.col("w.ts_end"),
    )
    counts = summary.select(F.struct("streams", "downloads", "uploads")).scalar()
    ramp = FD.emit(
        summary.where(F.col("sustained").isNotNull()).withColumn("w", w),
        finding_id="throughput_ramp", verdict="fyi", title="throughput", metric="throughput_sustained_bps",
        value_num=F.col("sustained"), unit="bytes_per_s", judged=F.col("streams"), **base,
    )
    side = lambda down, up: F.when(F.col("direction") == "down", down).otherwise(up)
    total = FD.emit(
        aggregate_throughput(aggregate_buckets(seg, stats, cfg)).withColumn("w", w).withColumn("n", counts),
        finding_id=F.concat(F.lit("throughput_aggregate_"), F.col("direction")), verdict="fyi", title="aggregate throughput",
        metric="throughput_aggregate_bps", value_num=F.col("peak"), unit="bytes_per_s", judged=side(F.col("n.downloads"), F.col("n.uploads")), **base,
    )
    loss = FD.emit(
        loss_timeline(summary).withColumn("w", w).withColumn("n", counts),
        finding_id=side(F.lit("loss_timeline_reorder"), F.lit("loss_timeline_retrans")), verdict="fyi", title="loss timeline",
        metric="loss_events", value_num=F.col("events"), value_str=F.col("phase"), unit="count",
        judged=side(F.col("n.downloads"), F.col("n.uploads")), **base,
    )
    bloat = FD.emit(
        worst_queueing(queueing(seg, stats, cfg), cfg).withColumn("w", w).withColumn("n", counts),
        finding_id="bufferbloat_onset", verdict=F.col("verdict"), title="bufferbloat", metric="srtt_inflation_ratio",
        value_num=F.col("ratio"), value_str=F.col("onset"), unit="ratio", judged=F.col("n.streams"), **base,
    )
    return FD.union_all([ramp, total, loss, bloat])
