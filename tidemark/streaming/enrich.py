"""Connection records with their handshake, resolution and region, as joins of live streams.

``plans.correlate.enriched_connections`` says what a record holds; this is its streaming twin. Closes meet the other events of
their socket in a stream-stream left outer join, and the address they were opened to meets its resolutions in a second
one, where they wait gathered by short spans of time. Both joins are bounded in event time, so their state is, and each is followed by an
aggregate by close that keeps the latest partner: five stateful operators, without a line of state code. A close leaves
once the watermarks of both sides have passed it (the span of its connect, too), with nulls for partners that never came.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.correlate import MAX_LIFE_NS, RESOLVED_WITHIN_NS, enriched_columns


#: Spans of time in the reach of a resolution.
SPANS = 24


def _live(events: DataFrame, ticks: DataFrame | None, late_by: str, key: str) -> DataFrame:
    """Events with their event time and watermark; ticks are rows of a clock alone, which let the watermark of a side that is silent go on.

    A tick has a key, though one that no row meets: joins drop rows without one before the watermark sees them.
    """
    rows = events if ticks is None else events.unionByName(ticks.withColumn(key, F.lit("")), allowMissingColumns=True)
    return rows.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", late_by)


def _only(condition: Column) -> Column:
    """The condition as one on event time: such a filter stays above the watermark, which so sees the ticks too."""
    return F.when(condition, F.col("at")).isNotNull()


def _micros(ns: int) -> Column:
    """At least that long: joins are bounded by event times in microseconds, and what they find is judged in nanoseconds after."""
    return F.make_dt_interval(secs=F.lit((ns // 1000 + 1) / 1e6).cast("decimal(18,6)"))


def _marked(sock: DataFrame, late: DataFrame, max_life_ns: int) -> DataFrame:
    """Closes with the latest connect, close and handshake facts before them."""
    closes = sock.where(_only(F.col("kind") == "close")).select("sock_cookie", "ts_ns", "seq", "at")
    marks = late.where(_only(F.col("kind").isin("connect", "close", "client_hello", "server_hello"))).select(
        F.col("sock_cookie").alias("m_cookie"), F.col("at").alias("m_at"), F.struct(F.col("ts_ns").alias("ts"), F.col("seq").alias("seq")).alias("m"),
        F.col("kind").alias("m_kind"), F.col("pid").alias("m_pid"), "ip", "sni", "tls_version", "cipher",
    )
    near = (F.col("sock_cookie") == F.col("m_cookie")) & (F.col("m_at") <= F.col("at")) & (F.col("m_at") >= F.col("at") - _micros(max_life_ns))
    before = F.col("m") < F.struct(F.col("ts_ns").alias("ts"), F.col("seq").alias("seq"))

    def last(condition: Column, *values: str) -> Column:
        return F.max(F.when(before & condition, F.struct(F.col("m.ts").alias("ts"), F.col("m.seq").alias("seq"), *values)))

    is_ = lambda kind: F.col("m_kind") == kind
    return (
        closes.join(marks, near, "left_outer")
        .groupBy("at", "sock_cookie", "ts_ns", "seq")
        .agg(
            last(is_("connect"), F.col("m_pid").alias("pid"), "ip").alias("opened"), last(is_("close")).alias("closed"),
            *[last(F.col(c).isNotNull(), F.col(c).alias("v")).alias(f"_{c}") for c in ("sni", "tls_version", "cipher")],
        )
    )


def enriched_stream(
    sockets: DataFrame, answers: DataFrame, regions: DataFrame, ticks: DataFrame | None = None, *, late_by: str = "10 seconds",
    max_life_ns: int = MAX_LIFE_NS, resolved_within_ns: int = RESOLVED_WITHIN_NS,
) -> DataFrame:
    """Streaming twin of ``plans.correlate.enriched_connections``; ``ticks`` (ts_ns) is a stream of clock readings.

    The latest connect counts if nothing closed since and it is at most ``max_life_ns`` old, and handshake facts if they are later than it.
    """
    found = _marked(_live(sockets, ticks, late_by, "sock_cookie"), _live(sockets, ticks, late_by, "sock_cookie"), max_life_ns)
    at = F.struct(F.col("opened.ts").alias("ts"), F.col("opened.seq").alias("seq"))
    open_ = F.col("opened").isNotNull() & (F.col("ts_ns") - F.col("opened.ts") <= max_life_ns)
    open_ = open_ & F.coalesce(at > F.struct("closed.ts", "closed.seq"), F.lit(True))
    conns = found.select("*", open_.alias("known")).select(
        "at", "sock_cookie", "seq", F.col("ts_ns").alias("close_ts"), "known",
        *[F.when(F.col("known"), F.col(f"opened.{c}")).alias(n) for c, n in (("ts", "connect_ts"), ("pid", "pid"), ("ip", "ip"))],
        *[F.when(F.col("known") & (F.struct(f"_{c}.ts", f"_{c}.seq") > at), F.col(f"_{c}.v")).alias(c) for c in ("sni", "tls_version", "cipher")],
    )
    # an address may be asked for all day: its answers are gathered by short spans of time, so that a connect meets a bounded number of spans
    # and looks into its own only. Connects and spans meet in cells of the reach; a span is in its own cell and the next
    width = max(1, resolved_within_ns // 1000 // SPANS)
    reach = -(-(resolved_within_ns // 1000 + 1) // width)
    span_of = lambda us: F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")
    cell_of = lambda span: F.expr(f"({span} - pmod({span}, {reach}L)) div {reach}L")
    named = (
        _live(answers, ticks, late_by, "ip").where(_only(F.col("host").isNotNull()))
        .groupBy(F.window("at", f"{width} microseconds").alias("w"), "ip")
        .agg(F.collect_list(F.struct(F.col("ts_ns").alias("a_ts"), F.col("seq").alias("a_seq"), "host")).alias("answers"))
        .select(F.col("ip").alias("a_ip"), F.window_time("w").alias("a_at"), F.unix_micros("w.start").alias("start_us"), "answers")
        .withColumn("a_span", span_of("start_us"))
        .select("a_ip", "a_at", "a_span", "answers", F.array_max("answers").alias("newest"), F.explode(F.array(cell_of("a_span"), cell_of("a_span") + 1)).alias("a_cell"))
    )
    conns = conns.withColumn("connect_us", F.expr("connect_ts div 1000")).withColumn("span", span_of("connect_us"))
    # a close without a connect meets nothing, but waits as the others do: not all of them in one task
    conns = conns.withColumn("cell", F.coalesce(cell_of("span"), F.xxhash64("sock_cookie", "seq")))
    bounds = (F.col("a_at") <= F.col("at") + F.lit(timedelta(microseconds=width + 1))) & (F.col("a_at") >= F.col("at") - _micros(max_life_ns + resolved_within_ns))
    near = (F.col("ip") == F.col("a_ip")) & (F.col("cell") == F.col("a_cell")) & (F.col("a_span") <= F.col("span")) & (F.col("a_span") >= F.col("span") - reach)
    in_time = lambda x: (x["a_ts"] <= F.col("connect_ts")) & (F.col("connect_ts") - x["a_ts"] <= resolved_within_ns)
    latest = F.when(F.col("a_span") == F.col("span"), F.array_max(F.filter("answers", in_time))).when(in_time(F.col("newest")), F.col("newest"))
    own = ["at", "sock_cookie", "seq", "close_ts", "known", "connect_ts", "pid", "ip", "sni", "tls_version", "cipher"]
    resolved = conns.join(named, near & bounds, "left_outer").withColumn("latest", latest).groupBy(*own).agg(F.max("latest").alias("r"))
    return (
        resolved.join(regions.select(F.col("ip").alias("r_ip"), "region"), F.col("ip") == F.col("r_ip"), "left")
        .select("*", F.col("r.host").alias("host"), F.col("r.a_ts").alias("resolved_ts"))
        .select(*enriched_columns())
    )
