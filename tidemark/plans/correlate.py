"""Socket and request events to connection and operation facts, as batch plans.

Events are ordered by (ts_ns, seq) within their key; every as-of lookup is a running
aggregate in slices, so a busy socket never sits in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.slices import SLICE, lagged, prefix, with_slices
from tidemark.session import materialize


def _at() -> Column:
    return F.struct("ts_ns", "seq")



def asof(
    left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, out: str, inclusive: bool = True
) -> DataFrame:
    """Left rows with ``out``: the struct of the latest right row of the key at or before them.

    Both sides carry ts_ns and seq. At equal times a right row counts when ``inclusive``.
    """
    value = F.struct(F.col("ts_ns").alias("at"), *values)
    both = left.select(*left.columns, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1 if inclusive else 0).alias("_side")).unionByName(
        right.select(*keys, "ts_ns", "seq", value.alias("_v"), F.lit(0 if inclusive else 1).alias("_side")), allowMissingColumns=True
    )
    ties = ("_side", "seq")
    found = prefix(both, keys, "ts_ns", {out: ("last", F.col("_v"))}, ties=ties)
    return found.where(F.col("_v").isNull()).drop("_v", "_side", SLICE)


def dns_pairs(dns: DataFrame) -> DataFrame:
    """Query and response: a response answers the latest query of its (socket, transaction) when
    the names agree; a query is answered once. One row per resolved address."""
    q = dns.where(F.col("kind") == "query")
    r = dns.where(F.col("kind") == "response").drop("kind")
    key = ["sock_cookie", "txn_id"]
    hit = asof(r, q.select(*key, "ts_ns", "seq", F.col("seq").alias("q_seq"), F.col("qname").alias("q_name")), key, ["q_seq", "q_name"], out="q")
    same = hit.where(F.col("q.q_name") == F.col("qname"))
    first = same.groupBy(*key, F.col("q.q_seq").alias("q_seq")).agg(
        F.min(F.struct("ts_ns", "seq", "qname", F.col("q.at").alias("query_ts"), "answers")).alias("x")
    )
    pairs = first.select(
        *key, F.col("x.qname").alias("qname"), F.col("x.query_ts").alias("query_ts"), F.col("x.ts_ns").alias("resolved_ts"),
        F.greatest(F.col("x.ts_ns") - F.col("x.query_ts"), F.lit(0)).alias("latency_ns"), F.size("x.answers").alias("n_answers"),
        F.explode("x.answers").alias("answer"), F.col("x.seq").alias("seq"),
    ).select("*", F.col("answer.ip").alias("ip"), F.col("answer.ttl_s").alias("ttl_s")).drop("answer")
    return materialize(pairs, "dns-pairs")


def connection_dns(connects: DataFrame, pairs: DataFrame, lookups: DataFrame) -> DataFrame:
    """Per connect the latest resolution of its peer; the resolver library's own timing wins when
    it is known for that host by then."""
    res = pairs.select("ip", F.col("resolved_ts").alias("ts_ns"), "seq", F.col("qname").alias("host"), "latency_ns", "ttl_s")
    named = asof(connects, res, ["ip"], ["host", "latency_ns", "ttl_s"], out="r").where(F.col("r").isNotNull())
    named = materialize(named.withColumn("host", F.col("r.host")), "named-connects")
    lib = lookups.select("host", "ts_ns", "seq", F.col("latency_ns").alias("lib_ns"), "cache_hit")
    out = asof(named, lib, ["host"], ["lib_ns", "cache_hit"], out="g")
    return out.select(
        "seq", "ip", "host", F.coalesce("g.lib_ns", "r.latency_ns").alias("latency_ns"),
        F.when(F.col("g").isNotNull(), "getaddrinfo").otherwise("wire").alias("via"), F.coalesce("g.cache_hit", F.lit(False)).alias("cache_hit"),
    )


def lookup_cache_hits(lookups: DataFrame, wire: DataFrame) -> DataFrame:
    """A lookup was served from cache iff no wire query for its host overlaps [start, end].

    Overlap exists iff some query that started by the end was answered at or after the start,
    which is a running maximum over query starts: no interval join.
    """
    w = wire.select("host", F.col("query_ts").alias("ts_ns"), F.lit(0).alias("_side"), F.col("resolved_ts").alias("_until"))
    l = lookups.select("host", "ts_ns", F.lit(1).alias("_side"), "seq", (F.col("ts_ns") - F.col("latency_ns")).alias("start"))
    run = prefix(l.unionByName(w, allowMissingColumns=True), ["host"], "ts_ns", {"reach": ("max", F.col("_until"))}, ties=("_side", "seq"))
    return run.where(F.col("_side") == 1).select(
        "seq", "host", "start", F.col("ts_ns").alias("end"), F.coalesce(F.col("reach") < F.col("start"), F.lit(True)).alias("cache_hit")
    )


def connect_close(events: DataFrame) -> DataFrame:
    """Every close with the connect right before it on its socket; without one it is partial
    and its process unknown (0)."""
    prev = lagged(
        events, ["sock_cookie"], "ts_ns", {"p_kind": ("kind", 1), "p_ts": ("ts_ns", 1), "p_pid": ("pid", 1)}, ties=("seq",)
    ).where(F.col("kind") == "close")
    known = F.coalesce(F.col("p_kind") == "connect", F.lit(False))
    return prev.select(
        "seq", "sock_cookie", F.when(known, F.col("p_ts")).alias("connect_ts"), F.col("ts_ns").alias("close_ts"),
        F.when(known, F.greatest(F.col("ts_ns") - F.col("p_ts"), F.lit(0))).alias("lifetime_ns"),
        F.when(known, F.col("p_pid")).otherwise(0).alias("pid"), (~known).alias("partial"),
    )


def tls_facts(events: DataFrame) -> DataFrame:
    """Per socket and connect: the last server name, version and cipher seen since it connected."""
    opened = (F.col("kind") == "connect").cast("int")
    ep = prefix(events, ["sock_cookie"], "ts_ns", {"epoch": ("sum", opened)}, ties=("seq",))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), _at()))
    return ep.groupBy("sock_cookie", "epoch").agg(latest("sni").alias("sni"), latest("tls_version").alias("tls_version"), latest("cipher").alias("cipher"))


#: How long a connection may have lived, and how old the resolution of its peer may be, to be joined to its close.
MAX_LIFE_NS = 2 * 86_400 * 10**9
RESOLVED_WITHIN_NS = 6 * 3_600 * 10**9


def enriched_columns() -> list[Column]:
    """What a record says, from a close with ``known`` (its connect was found) and its partners."""
    known = F.col("known")
    lifetime = F.when(known, F.greatest(F.col("close_ts") - F.col("connect_ts"), F.lit(0)))
    return [
        *map(F.col, ("sock_cookie", "seq", "connect_ts", "close_ts")), lifetime.alias("lifetime_ns"), F.coalesce("pid", F.lit(0)).alias("pid"),
        (~known).alias("partial"), *map(F.col, ("ip", "region", "sni", "tls_version", "cipher", "host")),
        (F.col("connect_ts") - F.col("resolved_ts")).alias("resolved_ago_ns"),
    ]


def enriched_connections(sockets: DataFrame, answers: DataFrame, regions: DataFrame, max_life_ns: int = MAX_LIFE_NS, resolved_within_ns: int = RESOLVED_WITHIN_NS) -> DataFrame:
    """One record for each close: its connect, the handshake since, the name its peer was resolved from, and the peer's region.

    ``sockets``: sock_cookie, ts_ns, seq, kind, pid, ip (of a connect), sni, tls_version, cipher. ``answers``: ip, ts_ns, seq, host.
    ``regions``: ip, region. The connect is the latest one before the close, unless the socket closed in between or it is more than
    ``max_life_ns`` old: then the record is partial, its process 0 and the rest unknown. The name is the latest one that an
    answer gave for the peer by the time of the connect, at most ``resolved_within_ns`` before.
    """
    last = lambda condition, *values: ("last", F.when(condition, F.struct(F.col("ts_ns").alias("ts"), "seq", *values)))
    is_ = lambda kind: F.col("kind") == kind
    seen = prefix(
        sockets, ["sock_cookie"], "ts_ns",
        {
            "opened": last(is_("connect"), "pid", "ip"), "closed": last(is_("close")),
            **{f"_{c}": last(F.col(c).isNotNull(), F.col(c).alias("v")) for c in ("sni", "tls_version", "cipher")},
        },
        ties=("seq",), frame="rows_before",
    ).where(is_("close"))
    at = F.struct("opened.ts", "opened.seq")
    known = F.col("opened").isNotNull() & (F.col("ts_ns") - F.col("opened.ts") <= max_life_ns) & F.coalesce(at > F.struct("closed.ts", "closed.seq"), F.lit(True))
    conns = materialize(
        seen.select("*", known.alias("known")).select(
            "sock_cookie", "seq", F.col("ts_ns").alias("close_ts"), "known",
            *[F.when(F.col("known"), F.col(f"opened.{c}")).alias(n) for c, n in (("ts", "connect_ts"), ("pid", "pid"), ("ip", "ip"))],
            *[F.when(F.col("known") & (F.struct(f"_{c}.ts", f"_{c}.seq") > at), F.col(f"_{c}.v")).alias(c) for c in ("sni", "tls_version", "cipher")],
        ),
        "closed-connections",
    )
    named = asof(conns.where("known").withColumn("ts_ns", F.col("connect_ts")), answers, ["ip"], ["host"], out="r")
    fresh = F.col("ts_ns") - F.col("r.at") <= resolved_within_ns
    named = named.select(*conns.columns, F.when(fresh, F.col("r.host")).alias("host"), F.when(fresh, F.col("r.at")).alias("resolved_ts"))
    whole = named.unionByName(conns.where("NOT known"), allowMissingColumns=True)
    return whole.join(regions, "ip", "left").select(*enriched_columns())


def fd_links(uses: DataFrame, links: DataFrame) -> DataFrame:
    """The socket behind (pid, fd) at each use: the most recent link wins."""
    return asof(uses, links, ["pid", "fd"], ["sock_cookie"], out="l").select("seq", "pid", "fd", F.col("l.sock_cookie").alias("sock_cookie"))


def request_sequence(requests: DataFrame) -> DataFrame:
    """Position of each request on its connection; any but the first reuses it."""
    n = prefix(requests, ["conn"], "ts_ns", {"req_seq": ("sum", F.lit(1))}, ties=("seq",), frame="rows_before")
    return n.select("conn", "seq", "req_seq", (F.col("req_seq") > 0).alias("connection_reused"))


def _expects_body(verb: Column, h: str) -> Column:
    return (
        (F.coalesce(F.col(f"{h}.content_length"), F.lit(0)) > 0) & (verb != "HEAD") & ~F.col(f"{h}.http_status").isin(204, 304) & F.col(f"{h}.head_complete")
    )


def correlate_requests(events: DataFrame) -> DataFrame:
    """One row per request with its response facts.

    ``events``: conn (host/pid/fd), ts_ns, seq, kind (request, response, body, link), verb,
    http_status, content_length, bytes, head_bytes, head_complete.
    Requests and links open epochs; a response head, body bytes up to the declared length
    and the next opener decide the rest. ``open`` marks a request nothing has closed yet.
    """
    opener = F.col("kind").isin("request", "link")
    ev = materialize(prefix(events, ["conn"], "ts_ns", {"epoch": ("sum", opener.cast("int"))}, ties=("seq",)), "epochs")
    ev = ev.where(F.col("epoch") > 0)
    final = (F.col("kind") == "response") & (F.col("http_status") >= 200)
    per = ev.groupBy("conn", "epoch").agg(
        F.min(F.when(opener, F.struct("ts_ns", "seq", "kind", "verb"))).alias("o"),
        F.min(F.when(final, F.struct("ts_ns", "seq", "http_status", "content_length", "bytes", "head_bytes", "head_complete"))).alias("h"),
        F.min(F.when((F.col("kind") == "response") & F.col("http_status").between(100, 199), _at())).alias("i"),
    )
    per = with_slices(materialize(per, "requests"), "epoch")
    waiting = per.where(F.col("h").isNotNull() & (F.col("o.kind") == "request") & _expects_body(F.col("o.verb"), "h")).select(
        "conn", "epoch", F.struct(F.col("h.ts_ns").alias("ts_ns"), F.col("h.seq").alias("seq")).alias("head_at"),
        (F.col("h.content_length") - F.greatest(F.col("h.bytes") - F.col("h.head_bytes"), F.lit(0))).alias("need"),
    )
    later = ev.join(waiting, ["conn", "epoch"]).where(F.col("kind").isin("response", "body") & (_at() > F.col("head_at")) & (F.col("need") > 0))
    tally = prefix(later.select("conn", "epoch", "ts_ns", "seq", "bytes", "need", SLICE), ["conn", "epoch"], "ts_ns", {"got": ("sum", F.col("bytes"))}, ties=("seq",))
    done = tally.where(F.col("got") >= F.col("need")).groupBy("conn", "epoch").agg(F.min("ts_ns").alias("body_ts"))
    full = waiting.where(F.col("need") <= 0).select("conn", "epoch", F.col("head_at.ts_ns").alias("body_ts"))
    ep = per.join(done.unionByName(full), ["conn", "epoch"], "left").join(waiting.select("conn", "epoch", F.lit(True).alias("expects")), ["conn", "epoch"], "left")
    ep = ep.select("*", F.col("o.kind").alias("o_kind"), F.col("h").isNull().alias("unanswered"))
    around = lagged(ep, ["conn"], "epoch", {"p_kind": ("o_kind", 1), "p_un": ("unanswered", 1), "n_kind": ("o_kind", -1)})
    links = prefix(around, ["conn"], "epoch", {"last_link": ("max", F.when(F.col("o_kind") == "link", F.col("epoch")))})
    is_req = lambda c: F.coalesce(F.col(c) == "request", F.lit(False))
    first = F.coalesce(F.when(F.col("i") < F.struct("h.ts_ns", "h.seq"), F.col("i.ts_ns")), F.when(F.col("h").isNull(), F.col("i.ts_ns")), F.col("h.ts_ns"))
    expects = F.coalesce("expects", F.lit(False))
    return links.where(F.col("o_kind") == "request").select(
        "conn", F.col("o.seq").alias("seq"), F.col("o.ts_ns").alias("ts_ns"), F.col("o.verb").alias("verb"),
        (F.col("epoch") - F.coalesce("last_link", F.lit(0)) - 1).alias("req_seq"),
        F.col("h.http_status").alias("http_status"), F.col("h.content_length").alias("content_length"),
        F.when(F.col("h").isNotNull() | F.col("i").isNotNull(), F.nullif(F.greatest(first - F.col("o.ts_ns"), F.lit(0)), F.lit(0))).alias("ttfb_ns"),
        F.when(F.col("body_ts").isNotNull(), F.greatest(F.col("body_ts") - F.col("h.ts_ns"), F.lit(0))).alias("download_ns"),
        F.when(F.col("body_ts").isNotNull(), F.greatest(F.col("body_ts") - F.col("o.ts_ns"), F.lit(0))).alias("total_ns"),
        F.coalesce(~F.col("h.head_complete"), F.lit(False)).alias("partial"),
        F.when((F.col("unanswered") & is_req("n_kind")) | (is_req("p_kind") & F.col("p_un")), "ambiguous").otherwise("clean").alias("delimitation"),
        (F.col("n_kind").isNull() & (F.col("unanswered") | (expects & F.col("body_ts").isNull()))).alias("open"),
    )
