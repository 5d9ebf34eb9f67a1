"""The general tables re-shaped as capture tables (requests, connections, samples, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.slices import SLICE, prefix, uncut, with_slices


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(read(spark, sf_dir, "events"))


def event_columns(events: DataFrame) -> DataFrame:
    # the generator keeps the JSON parse in one place: filters on columns derived from k
    # would otherwise be pushed below a projection and parse props once per mention
    return events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS ts_ns",
        "explode(array(CAST(get_json_object(props, '$.k') AS INT))) AS k",
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: one per event."""
    return ops_from(base_events(spark, sf_dir))


def ops_from(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CAST(event_id AS STRING) AS op_id",
        "ts_ns",
        "CAST(user_id AS STRING) AS sock_cookie",
        "user_id % 8 AS pid",
        """CASE event_type WHEN 'click' THEN 'HEAD' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS verb""",
        """CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'error' THEN 'GetObject' WHEN 'click' THEN 'HeadObject'
           WHEN 'purchase' THEN 'PutObject' ELSE 'ListObjectsV2' END AS s3_op""",
        "CASE WHEN k % 10 = 9 THEN NULL ELSE concat('b', CAST(user_id % 5 AS STRING)) END AS bucket",
        "concat('k', CAST(k AS STRING)) AS key_hash",
        """CASE WHEN k = 99 THEN NULL WHEN event_type <> 'error' THEN 200 WHEN k % 5 = 0 THEN 503 WHEN k % 5 = 1 THEN 500
           WHEN k % 5 = 2 THEN 404 WHEN k % 5 = 3 THEN 403 ELSE 400 END AS http_status""",
        "CAST(round(value * 1000000) AS BIGINT) AS ttfb_ns",
        "CASE WHEN event_type = 'view' THEN CAST(round(value * 2000000) AS BIGINT) END AS download_ns",
        "CAST(round(value * 10000000000) AS BIGINT) AS total_ns",
        "CASE WHEN k % 7 <> 0 THEN CAST((k + 1) * 4096 AS BIGINT) END AS content_length",
        "CASE WHEN k % 5 <> 0 THEN CAST((k + 1) * 4096 + 512 AS BIGINT) END AS op_bytes_recv",
        "CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN CAST(round(value * 300000) AS BIGINT) END AS tcp_connect_ns",
        "CASE WHEN k % 15 = 0 THEN CAST(round(value * 50000) AS BIGINT) END AS tls_handshake_ns",
        "CASE WHEN k % 6 = 0 THEN CAST(round(value * 100000) AS BIGINT) END AS dns_latency_ns",
        "CASE WHEN k % 6 = 0 THEN k % 4 = 0 END AS dns_cache_hit",
        "CASE WHEN k % 2 = 1 THEN concat('req-', CAST(event_id AS STRING)) END AS aws_request_id",
        "k % 3 <> 0 AS connection_reused",
        "k % 20 = 7 AS partial",
        "CASE WHEN k % 25 = 3 THEN 'ambiguous' ELSE 'clean' END AS delimitation",
    )


def conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections at close: one per customer; sockets join requests on sock_cookie."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .selectExpr(
            "CAST(c_custkey AS STRING) AS sock_cookie",
            "c_custkey % 8 AS pid",
            "lower(r_name) AS region",
            "concat('10.0.0.', CAST(n_nationkey AS STRING)) AS endpoint_ip",
            "n_nationkey % 10 = 9 AS cross_region",
            "n_nationkey % 5 = 4 AS via_vpce",
            "concat('b', CAST(c_custkey % 5 AS STRING), '.s3.eu-west-', CAST(n_regionkey AS STRING), '.amazonaws.com') AS sni",
            "CAST(c_custkey * 1000 AS BIGINT) AS ts_ns",
            "CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1000 * (1 + n_regionkey) + c_custkey % 997 END AS BIGINT) AS srtt_us",
            "CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 900 * (1 + n_regionkey) END AS BIGINT) AS min_rtt_us",
            "CAST(CASE WHEN c_custkey % 7 <> 0 THEN 100 + c_custkey % 3800 END AS BIGINT) AS rttvar_us",
            "CAST(abs(round(c_acctbal)) AS BIGINT) * 100 AS bytes_sent",
            "CAST(abs(round(c_acctbal)) AS BIGINT) * (c_custkey % 5) * 100 AS bytes_recv",
            "CAST(c_custkey % 3 AS BIGINT) AS retransmits",
            "CAST((c_custkey % 3) * 1460 AS BIGINT) AS bytes_retrans",
            "CASE WHEN c_custkey % 6 <> 0 THEN CAST((500 + c_custkey % 977) * 1000 AS BIGINT) END AS tls_handshake_ns",
            "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'TLSv1.2' ELSE 'TLSv1.3' END AS tls_version",
            "CASE WHEN c_custkey % 5 <> 0 THEN CAST(4865 + c_custkey % 3 AS INT) END AS tls_cipher",
            "CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 50 AS BIGINT) END AS busy_jiffies",
            "CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 7 AS BIGINT) END AS rwnd_limited_jiffies",
            "CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 3 AS BIGINT) END AS sndbuf_limited_jiffies",
            "CASE WHEN c_custkey % 40 <> 0 THEN CAST(c_custkey % 40 AS BIGINT) END AS snd_cwnd",
            "CASE WHEN c_custkey % 10 <> 0 THEN CAST(1460 AS BIGINT) END AS mss",
            "CASE WHEN c_custkey % 8 <> 0 THEN CAST((c_custkey % 1000) * 20000 AS BIGINT) END AS delivery_rate_bps",
            "CASE WHEN c_custkey % 2 = 0 THEN true END AS app_limited",
            "CAST(65536 * (1 + c_custkey % 4) AS BIGINT) AS window_clamp",
            "CAST((1 + c_custkey % 100) * 100000000 AS BIGINT) AS lifetime_ns",
            "CASE WHEN c_custkey % 2 = 0 THEN CAST(3 + c_custkey % 3 AS BIGINT) END AS reordering",
            "CASE WHEN c_custkey % 50 = 0 THEN 3 END AS ca_state",
            "CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 4 AS BIGINT) END AS rcv_ooopack",
            "CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 6 AS BIGINT) END AS dsack_dups",
            "CASE WHEN c_custkey % 2 = 0 THEN 'p0' ELSE 'p1' END AS provider",
            "c_mktsegment AS tier",
        )
    )


SAMPLE_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def samples(spark: SparkSession, sf_dir: str, sliced: bool = False) -> DataFrame:
    """In-flight snapshots: cumulative counters per supplier socket, reset every year.

    One day becomes 0.1 s, so intervals are a fraction of a second to a few seconds.
    Even sockets download, odd ones upload. ``sliced`` keeps the slices of sockets, so that ``timeseries.segments`` goes on in the same tasks.
    """
    li = read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS sock_cookie",
        """(unix_micros(CAST(l_shipdate AS TIMESTAMP)) div 86400000000) * 100000000
           + (l_orderkey * 7919 + l_linenumber * 104729) % 100000000 AS ts_ns""",
        "year(l_shipdate) AS epoch",
        "l_quantity", "l_tax", "l_discount", *SAMPLE_TIES,
    )
    li = with_slices(li, "ts_ns", keys=["sock_cookie"])
    if uncut(li):  # one shuffle for the counters and for all that is asked of a socket after
        li = li.repartition("sock_cookie")
    li = li.selectExpr(
        "*",
        "CAST(sock_cookie AS BIGINT) % 2 = 0 AS down",
        "CAST(round(l_extendedprice) AS BIGINT) AS big",
        "CAST(round(l_quantity) AS BIGINT) AS qty",
    )
    run = prefix(
        li,
        ["sock_cookie", "epoch"],
        "ts_ns",
        {
            "_big": ("sum", F.col("big")),
            "_small": ("sum", F.col("qty") * 10),
            "_retrans": ("sum", F.col("qty") % 3),
            "_ooo": ("sum", F.col("l_linenumber") % 4),
        },
        ties=SAMPLE_TIES,
    )
    return run.selectExpr(
        "sock_cookie",
        "ts_ns",
        "CASE WHEN down THEN _big ELSE _small END AS bytes_recv",
        "CASE WHEN down THEN _small ELSE _big END AS bytes_sent",
        "CAST(_retrans AS BIGINT) AS total_retrans",
        "CAST(_ooo AS BIGINT) AS rcv_ooopack",
        "CAST(round(l_tax * 100000) + 1000 AS BIGINT) AS srtt_us",
        "CASE WHEN qty % 11 <> 0 THEN CAST(1000 + qty * 10 AS BIGINT) END AS min_rtt_us",
        "CASE WHEN qty % 4 <> 0 THEN big * 10 END AS delivery_rate_bps",
        "l_discount > 0.08 AS rate_app_limited",
        "10 + qty AS snd_cwnd",
        "CAST(65536 + l_linenumber * 1000 AS BIGINT) AS rcv_wnd",
        *SAMPLE_TIES,
        *([SLICE] if sliced else []),
    )


def sample_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots' clock and round trips alone, without the running counters."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS sock_cookie",
        """(unix_micros(CAST(l_shipdate AS TIMESTAMP)) div 86400000000) * 100000000
           + (l_orderkey * 7919 + l_linenumber * 104729) % 100000000 AS ts_ns""",
        "CAST(round(l_tax * 100000) + 1000 AS BIGINT) AS srtt_us",
        "CASE WHEN CAST(round(l_quantity) AS BIGINT) % 11 <> 0 THEN CAST(1000 + CAST(round(l_quantity) AS BIGINT) * 10 AS BIGINT) END AS min_rtt_us",
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised object accesses: the demand gates applied to the requests."""
    return demand_trace(ops(spark, sf_dir))


def demand_trace(o: DataFrame) -> DataFrame:
    """Requests to accesses. Partial reads are dropped, partial writes still invalidate."""
    kind = C.op_kind(F.col("s3_op"), F.col("verb"))
    return (
        o.where(~F.col("partial") | F.col("s3_op").isin(C.WRITE_OPS))
        .select(
            "ts_ns",
            "op_id",
            C.demand_op(kind, F.col("http_status")).alias("op"),
            C.object_id(F.col("bucket"), F.col("key_hash")).alias("object_id"),
            F.col("content_length").alias("size"),
            F.col("http_status").alias("status"),
            F.col("pid").alias("app"),
        )
        .where(F.col("op").isNotNull() & F.col("object_id").isNotNull() & F.col("ts_ns").isNotNull())
    )


def weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines: page URLs, half of them re-hosted on object-store endpoints."""
    return (
        read(spark, sf_dir, "pages")
        .selectExpr(
            "page_id",
            "regexp_extract(url, '^https?://([^/?#]+)', 1) AS site",
            "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS url_path",
            r"regexp_extract(url, '[?]([^#]*)', 1) AS url_query",
        )
        .selectExpr(
            "page_id",
            """CASE page_id % 7 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'PUT' WHEN 2 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'GET' END
               AS method""",
            "CASE WHEN page_id % 11 = 0 THEN '/' WHEN url_path = '' THEN '/' ELSE url_path END AS path",
            """CASE page_id % 9 WHEN 0 THEN 'list-type=2&prefix=x' WHEN 1 THEN 'uploads' WHEN 2 THEN 'uploadId=u1&partNumber=3'
               WHEN 3 THEN 'delete' WHEN 4 THEN 'session' WHEN 5 THEN 'X-Amz-Signature=abc&versionId=v1' ELSE url_query END
               AS query""",
            """CASE page_id % 8 WHEN 0 THEN concat(split_part(site, '.', 2), '.s3.us-west-2.amazonaws.com')
               WHEN 1 THEN 's3.dualstack.eu-central-1.amazonaws.com:443' WHEN 2 THEN concat('Data.', split_part(site, '.', 1), '.S3-ap-south-1.amazonaws.com')
               WHEN 3 THEN 's3.amazonaws.com' WHEN 4 THEN 'example.com:9000' WHEN 5 THEN 'x.s3.amazonaws.com.' ELSE site END
               AS host""",
        )
    )


def wire_events(events: DataFrame) -> DataFrame:
    """Decoded request traffic per (host, pid, fd): requests, responses, body reads, new links."""
    return events.selectExpr(
        "concat('h', CAST(user_id % 3 AS STRING), '/', CAST(user_id % 8 AS STRING), '/', CAST(user_id AS STRING)) AS conn",
        "ts_ns",
        "event_id AS seq",
        """CASE WHEN k = 50 THEN 'link' WHEN event_type IN ('click', 'purchase') THEN 'request' WHEN event_type = 'signup' THEN 'body'
           ELSE 'response' END AS kind""",
        "CASE WHEN k % 9 = 0 THEN 'HEAD' WHEN event_type = 'purchase' THEN 'PUT' ELSE 'GET' END AS verb",
        "CAST(CASE WHEN k % 10 = 0 THEN 100 WHEN event_type = 'error' THEN 500 WHEN k % 13 = 0 THEN 204 ELSE 200 END AS INT) AS http_status",
        "CASE WHEN k % 4 <> 0 THEN CAST(k * 3 AS BIGINT) END AS content_length",
        "CAST(CASE WHEN event_type = 'signup' THEN k * 2 ELSE 200 + k END AS BIGINT) AS bytes",
        "CAST(200 AS BIGINT) AS head_bytes",
        "k % 17 <> 0 AS head_complete",
    )


def socket_events(events: DataFrame) -> DataFrame:
    """Connects and closes per socket, with the handshake facts seen in between."""
    return events.selectExpr(
        "CAST(user_id AS STRING) AS sock_cookie", "ts_ns", "event_id AS seq", "user_id % 8 AS pid",
        """CASE event_type WHEN 'purchase' THEN 'connect' WHEN 'signup' THEN 'close' WHEN 'click' THEN 'client_hello' WHEN 'view' THEN 'server_hello'
           ELSE 'other' END AS kind""",
        "CASE WHEN event_type = 'click' THEN concat('b', CAST(k % 5 AS STRING), '.s3.eu-west-1.amazonaws.com') END AS sni",
        "CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN concat('TLSv1.', CAST(2 + k % 2 AS STRING)) END AS tls_version",
        "CASE WHEN event_type = 'view' AND k % 5 <> 0 THEN 4865 + k % 3 END AS cipher",
    )


def dns_events(events: DataFrame) -> DataFrame:
    return events.where("event_type IN ('click', 'view')").selectExpr(
        "CAST(user_id % 10 AS STRING) AS sock_cookie", "k % 4 AS txn_id", "ts_ns", "event_id AS seq",
        "CASE event_type WHEN 'click' THEN 'query' ELSE 'response' END AS kind", "concat('n', CAST(k % 2 AS STRING)) AS qname",
        """CASE WHEN event_type = 'view' THEN array(named_struct('ip', concat('10.9.0.', CAST(k % 30 AS STRING)), 'ttl_s', CAST(k AS BIGINT)))
           END AS answers""",
    )


def lookups(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").selectExpr(
        "concat('n', CAST(k % 2 AS STRING)) AS host", "ts_ns", "event_id AS seq", "CAST(round(value * 10000000000) AS BIGINT) AS latency_ns", "k % 4 = 0 AS cache_hit"
    )


def with_turns(events: DataFrame, days: int = 5) -> DataFrame:
    """Events with the ``turn`` they arrive in: each is up to a week under way, and a turn takes some days."""
    return events.withColumn("turn", F.expr(f"CAST((ts_ns + CAST(k AS BIGINT) * k * 60000000000) div {days * 86_400_000_000_000} AS INT)"))


def numbered_samples(samples_: DataFrame) -> DataFrame:
    """The counters of ``samples`` with one number that orders equal times as its ties do."""
    return samples_.selectExpr("sock_cookie", "ts_ns", "l_orderkey * 8 + l_linenumber AS seq", "bytes_recv", "bytes_sent", "total_retrans")


def connects(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").selectExpr("concat('10.9.0.', CAST(k % 30 AS STRING)) AS ip", "ts_ns", "event_id AS seq")


def peer_sockets(events: DataFrame) -> DataFrame:
    """``socket_events`` with the peer address of each connect."""
    own = socket_events(events.where("event_type <> 'error'"))
    return own.withColumn("ip", F.when(F.col("kind") == "connect", F.concat(F.lit("10.9.0."), (F.col("seq") % 30).cast("string"))))


def address_answers(events: DataFrame) -> DataFrame:
    """The addresses that names resolved to."""
    return events.where("event_type = 'view'").selectExpr("concat('10.9.0.', CAST(k % 30 AS STRING)) AS ip", "ts_ns", "event_id AS seq", "concat('n', CAST(k % 2 AS STRING)) AS host")


def address_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each known address; some addresses of ``peer_sockets`` have none."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).selectExpr("concat('10.9.0.', CAST(n_nationkey AS STRING)) AS ip", "lower(r_name) AS region")
