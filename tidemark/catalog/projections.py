"""Predicates, classifications and row-level projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.functions import columns as C
from tidemark.functions import http as H
from tidemark.plans import projections as P
from tidemark.sources import tables as T

ENDPOINTS = ["example.com", "minio.local"]
SALT = bytes(range(16))

QUERIES = {
    "prj1_latency_eligible": lambda s, d: T.ops(s, d).where(C.eligible()).select("op_id", "s3_op", "ttfb_ns"),
    "prj2_timeable": lambda s, d: T.ops(s, d).where(C.timeable()).select("op_id", "http_status", "ttfb_ns"),
    "prj3_status_class": lambda s, d: T.ops(s, d)
    .select(C.status_class(F.col("http_status")).alias("status_class"))
    .groupBy("status_class")
    .agg(F.count(F.lit(1)).alias("n")),
    "prj4_price_tier": lambda s, d: T.ops(s, d)
    .select("s3_op", C.price_tier(F.col("s3_op")).alias("tier"))
    .groupBy("s3_op", "tier")
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumn("usd_per_1k", C.price_per_1k(F.col("tier"))),
    "prj5_usable_rtt": lambda s, d: T.conns(s, d).select("sock_cookie", C.conn_floor_us().alias("floor_us")),
    "prj6_direction": lambda s, d: T.conns(s, d)
    .select(F.when(C.send_heavy(), "send").when(C.recv_heavy(), "recv").otherwise("none").alias("direction"), "bytes_sent", "bytes_recv")
    .groupBy("direction")
    .agg(F.count(F.lit(1)).alias("conns"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_recv").alias("bytes_recv")),
    "prj7_op_kind": lambda s, d: T.ops(s, d)
    .select(
        C.op_kind(F.col("s3_op"), F.col("verb")).alias("kind"),
        C.op_kind(F.lit(None).cast("string"), F.col("verb")).alias("verb_kind"),
    )
    .groupBy("kind", "verb_kind")
    .agg(F.count(F.lit(1)).alias("n")),
    "prj8_demand_gate": lambda s, d: T.trace(s, d).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n")),
    "prj9_object_identity": lambda s, d: T.ops(s, d)
    .select(C.object_id(F.col("bucket"), F.col("key_hash")).alias("object_id"))
    .where(F.col("object_id").isNotNull())
    .groupBy("object_id")
    .agg(F.count(F.lit(1)).alias("n")),
    "prj10_ranged_share": lambda s, d: P.ranged_share(
        T.demand_trace(
            T.ops(s, d).withColumn(
                "http_status", F.when((F.col("http_status") == 200) & (F.col("content_length") % 13 == 0), 206).otherwise(F.col("http_status"))
            )
        ).withColumn("range_start", F.when(F.col("size") % 26 == 0, F.lit(0)))
    ),
    "prj11_scope_filter": lambda s, d: P.in_scope(T.ops(s, d), pids=[1, 3, 5]).groupBy("pid").agg(F.count(F.lit(1)).alias("n")),
    "prj11_scope_table": lambda s, d: P.in_scope(
        T.ops(s, d), scope=T.conns(s, d).where("cross_region").select("pid")
    ).groupBy("pid").agg(F.count(F.lit(1)).alias("n")),
    "prj12_phase_breakdown": lambda s, d: P.phase_breakdown(T.ops(s, d)),
    "prj13_request_table": lambda s, d: P.request_table(T.ops(s, d)),
    "prj14_distance_band": lambda s, d: T.conns(s, d).select(
        "sock_cookie",
        C.distance_band(F.col("srtt_us") / 100.0).alias("band"),
        C.region_city(H.region_from_host(F.col("sni"))).alias("city"),
    ),
    "prj15_classify_request": lambda s, d: T.weblog(s, d).select(
        "page_id", H.classify_request(F.col("method"), F.col("path"), F.col("query")).alias("s3_op")
    ),
    "prj16_resolve_bucket_key": lambda s, d: T.weblog(s, d)
    .select("page_id", H.resolve_request(F.col("method"), F.col("path"), F.col("query"), F.col("host"), ENDPOINTS).alias("r"))
    .select("page_id", "r.*"),
    "prj17_region_from_host": lambda s, d: T.weblog(s, d).select(
        "page_id", H.region_from_host(H.host_without_port(F.col("host"))).alias("region")
    ),
    "prj18_redact": lambda s, d: T.weblog(s, d).select(
        "page_id",
        H.redact_request_line(
            F.concat(
                F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("log: "), F.col("method"))).otherwise(F.col("method")),
                F.lit(" "), F.col("path"), F.lit("?"), F.col("query"), F.lit("&X-Amz-Expires=60 HTTP/1.1"),
            )
        ).alias("line"),
    ),
    "prj19_keyed_hash": lambda s, d: T.ops(s, d).select("op_id", H.keyed_hash(SALT, F.col("key_hash")).alias("hashed")),
    "prj20_sanitize": lambda s, d: T.read(s, d, "documents")
    .select(C.sanitize_term(F.concat("source", F.when(F.col("doc_id") % 3 == 0, "​").when(F.col("doc_id") % 3 == 1, "‮").otherwise(""))).alias("term"),
            F.length(C.sanitize_term(F.col("text"))).alias("len"), (F.length(F.col("text")) - F.length(F.regexp_replace(C.sanitize_term(F.col("text")), "�", ""))).alias("bad"))
    .groupBy("term")
    .agg(F.count(F.lit(1)).alias("n"), F.sum("len").cast("bigint").alias("chars"), F.sum("bad").cast("bigint").alias("replaced")),
    "prj21_normalize_endpoint": lambda s, d: T.conns(s, d)
    .withColumn(
        "raw_ip",
        F.when(F.col("pid") % 3 == 0, F.concat(F.lit("::ffff:"), F.col("endpoint_ip")))
        .when(F.col("pid") % 3 == 1, F.concat(F.lit("::FFFF:0a00:00"), F.lpad(F.lower(F.hex(F.col("pid") + 16)), 2, "0")))
        .when(F.col("pid") == 2, "2001:db8::1")
        .otherwise(F.col("endpoint_ip")),
    )
    .select("sock_cookie", C.normalize_ip(F.col("raw_ip")).alias("ip"), C.ip_family(C.normalize_ip(F.col("raw_ip"))).alias("family")),
    "prj22_sentinels": lambda s, d: T.conns(s, d).select(
        "sock_cookie",
        C.null_if(F.col("srtt_us"), 0).alias("srtt_us"),
        C.null_if(F.coalesce("min_rtt_us", F.lit(4294967295)), 0, 4294967295).alias("min_rtt_us"),
        *[
            F.when(sum_jiffies() != 0, F.coalesce(c, F.lit(0))).alias(c)
            for c in ("busy_jiffies", "rwnd_limited_jiffies", "sndbuf_limited_jiffies")
        ],
    ),
}


def sum_jiffies():
    return sum((F.coalesce(c, F.lit(0)) for c in ("rwnd_limited_jiffies", "sndbuf_limited_jiffies")), F.coalesce("busy_jiffies", F.lit(0)))


_OPS = f"WITH {S.OPS} "


def _classify(method: str, path: str, query: str) -> str:
    def has(k: str) -> str:
        return f"regexp_matches({query}, '(^|&){k}(=|&|$)')"

    return f"""CASE WHEN {method} = 'GET' AND {has('session')} THEN 'CreateSession'
 WHEN {method} = 'GET' AND regexp_extract({query}, '(?:^|&)list-type(?:=([^&]*))?(?:&|$)', 1) = '2' THEN 'ListObjectsV2'
 WHEN {method} = 'GET' AND length({path}) <= 1 THEN 'ListObjects' WHEN {method} = 'GET' THEN 'GetObject'
 WHEN {method} = 'HEAD' AND length({path}) > 1 THEN 'HeadObject'
 WHEN {method} = 'PUT' AND {has('partNumber')} AND {has('uploadId')} THEN 'UploadPart'
 WHEN {method} = 'PUT' AND length({path}) > 1 THEN 'PutObject'
 WHEN {method} = 'POST' AND {has('delete')} THEN 'DeleteObjects' WHEN {method} = 'POST' AND {has('uploads')} THEN 'CreateMultipartUpload'
 WHEN {method} = 'POST' AND {has('uploadId')} THEN 'CompleteMultipartUpload'
 WHEN {method} = 'DELETE' AND {has('uploadId')} THEN 'AbortMultipartUpload'
 WHEN {method} = 'DELETE' AND length({path}) > 1 THEN 'DeleteObject' ELSE 'UNKNOWN' END"""


_HOST = "CASE WHEN regexp_matches(host, '^[^:\\[][^:]*:[0-9]+$') THEN regexp_extract(host, '^([^:\\[][^:]*):[0-9]+$', 1) ELSE host END"
_REGION = "[a-z]{2}(?:-[a-z]+){1,2}-[0-9]+"
REGION_SQL = f"""CASE WHEN ends_with(rtrim(h, '.'), '.amazonaws.com') OR rtrim(h, '.') = 'amazonaws.com' THEN
 CASE WHEN regexp_extract(rtrim(h, '.'), '(?:^|\\.)(?:s3\\.(?:dualstack\\.)?({_REGION})|s3-({_REGION})\\.amazonaws)(?:\\.|$)', 1) <> ''
      THEN regexp_extract(rtrim(h, '.'), '(?:^|\\.)(?:s3\\.(?:dualstack\\.)?({_REGION})|s3-({_REGION})\\.amazonaws)(?:\\.|$)', 1)
      WHEN regexp_extract(rtrim(h, '.'), '(?:^|\\.)(?:s3\\.(?:dualstack\\.)?({_REGION})|s3-({_REGION})\\.amazonaws)(?:\\.|$)', 2) <> ''
      THEN regexp_extract(rtrim(h, '.'), '(?:^|\\.)(?:s3\\.(?:dualstack\\.)?({_REGION})|s3-({_REGION})\\.amazonaws)(?:\\.|$)', 2)
      WHEN list_contains(string_split(rtrim(h, '.'), '.'), 's3') THEN 'us-east-1' END END"""


def _sql_bytes(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


_IPAD = _sql_bytes(bytes(b ^ 0x36 for b in SALT.ljust(64, b"\0")))
_OPAD = _sql_bytes(bytes(b ^ 0x5C for b in SALT.ljust(64, b"\0")))
_PAIR = """CASE WHEN NOT contains(p, '=') OR lower(split_part(p, '=', 1)) IN ('versionid', 'partnumber', 'uploadid', 'list-type',
 'delete', 'uploads', 'session') THEN p ELSE split_part(p, '=', 1) || '=REDACTED' END"""
_CITY = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in C.REGION_CITIES.items())

ORACLES = {
    "prj1_latency_eligible": _OPS + "SELECT op_id, s3_op, ttfb_ns FROM opf WHERE elig",
    "prj2_timeable": _OPS + "SELECT op_id, http_status, ttfb_ns FROM opf WHERE good",
    "prj3_status_class": _OPS + "SELECT cls AS status_class, count(*) AS n FROM opf GROUP BY 1",
    "prj4_price_tier": _OPS
    + """SELECT s3_op, tier, n, CASE tier WHEN 'free' THEN CAST(0 AS DOUBLE) WHEN 'tier-1' THEN CAST(0.005 AS DOUBLE) ELSE CAST(0.0004 AS DOUBLE) END AS usd_per_1k
 FROM (SELECT s3_op, CASE WHEN regexp_matches(s3_op, '^(Delete|Abort)') THEN 'free'
   WHEN regexp_matches(s3_op, '^(Put|Post|Copy|List|Create|Upload|Complete)') THEN 'tier-1' ELSE 'tier-2' END AS tier, count(*) AS n
 FROM ops GROUP BY 1, 2)""",
    "prj5_usable_rtt": f"WITH {S.CONNS} SELECT sock_cookie, floor_us FROM connf",
    "prj6_direction": f"""WITH {S.CONNS} SELECT CASE WHEN send_heavy THEN 'send' WHEN recv_heavy THEN 'recv' ELSE 'none' END AS direction,
 count(*) AS conns, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(bytes_recv) AS BIGINT) AS bytes_recv FROM connf GROUP BY 1""",
    "prj7_op_kind": _OPS
    + """SELECT CASE s3_op WHEN 'GetObject' THEN 'get' WHEN 'HeadObject' THEN 'head' WHEN 'PutObject' THEN 'put' ELSE 'other' END AS kind,
 lower(verb) AS verb_kind, count(*) AS n FROM ops GROUP BY 1, 2""",
    "prj8_demand_gate": f"WITH {S.TRACE} SELECT op, status, count(*) AS n FROM trace GROUP BY 1, 2",
    "prj9_object_identity": _OPS + "SELECT bucket || '/' || key_hash AS object_id, count(*) AS n FROM ops WHERE bucket IS NOT NULL GROUP BY 1",
    "prj10_ranged_share": _OPS
    + """, x AS (SELECT s3_op, partial, bucket, content_length AS size,
 CASE WHEN http_status = 200 AND content_length % 13 = 0 THEN 206 ELSE http_status END AS st FROM ops),
 t AS (SELECT CASE WHEN s3_op = 'GetObject' AND st = 206 THEN 'other' WHEN s3_op = 'GetObject' THEN 'get' ELSE 'x' END AS op,
 coalesce(st = 206, false) AS ranged, CASE WHEN size % 26 = 0 THEN 0 END AS rs
 FROM x WHERE (NOT partial OR s3_op = 'PutObject') AND bucket IS NOT NULL AND (s3_op <> 'GetObject' OR st IN (200, 206))),
 a AS (SELECT count(*) FILTER (WHERE op = 'get' AND NOT ranged) AS whole_gets, count(*) FILTER (WHERE ranged) AS ranged,
 count(*) FILTER (WHERE ranged AND rs IS NULL) AS unplaceable, count(*) FILTER (WHERE op = 'get' OR ranged) AS body_reads FROM t)
 SELECT *, CASE WHEN body_reads > 0 THEN unplaceable / body_reads ELSE CAST(0 AS DOUBLE) END AS ranged_frac FROM a""",
    "prj11_scope_filter": _OPS + "SELECT pid, count(*) AS n FROM ops WHERE pid IN (1, 3, 5) GROUP BY 1",
    "prj11_scope_table": f"WITH {S.OPS}, {S.CONNS} SELECT pid, count(*) AS n FROM ops WHERE pid IN (SELECT pid FROM conns WHERE cross_region) GROUP BY 1",
    "prj12_phase_breakdown": _OPS
    + """, p AS (SELECT op_id, connection_reused AS r, CASE WHEN NOT connection_reused THEN dns_latency_ns END AS a,
 CASE WHEN NOT connection_reused THEN tcp_connect_ns END AS b, CASE WHEN NOT connection_reused THEN tls_handshake_ns END AS c,
 ttfb_ns AS d, download_ns AS f FROM ops),
 q AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(f, 0) AS tot FROM p),
 z AS (SELECT op_id, 0 AS phase_no, 'dns' AS phase, a AS ns, tot, CAST(0 AS BIGINT) AS off FROM q WHERE NOT r
 UNION ALL SELECT op_id, 1, 'tcp_connect', b, tot, coalesce(a, 0) FROM q WHERE NOT r
 UNION ALL SELECT op_id, 2, 'tls_handshake', c, tot, coalesce(a, 0) + coalesce(b, 0) FROM q WHERE NOT r
 UNION ALL SELECT op_id, 3, 'request_ttfb', d, tot, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) FROM q
 UNION ALL SELECT op_id, 4, 'download', f, tot, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) FROM q)
 SELECT op_id, phase_no, phase, ns, CASE WHEN ns IS NOT NULL AND tot > 0 THEN ns / tot END AS share,
 CASE WHEN ns IS NOT NULL THEN off END AS offset_ns FROM z""",
    "prj13_request_table": _OPS
    + """SELECT op_id, coalesce(s3_op, '?') AS op, coalesce(bucket, '?') AS bucket, coalesce(CAST(http_status AS VARCHAR), '-') AS code,
 ttfb_ns / 1e6 AS ttfb_ms, CASE WHEN connection_reused THEN 'reuse' ELSE 'new' END AS connection, coalesce(op_bytes_recv, 0) AS bytes,
 CASE WHEN partial THEN 'P' ELSE '' END || CASE WHEN delimitation = 'ambiguous' THEN 'A' ELSE '' END || CASE WHEN dns_cache_hit THEN 'C' ELSE '' END AS flags
 FROM ops""",
    "prj14_distance_band": f"""WITH {S.CONNS} SELECT sock_cookie, CASE WHEN srtt_us / 100.0 < 5 THEN '~in-region' WHEN srtt_us / 100.0 < 40 THEN '~regional'
 WHEN srtt_us / 100.0 < 100 THEN '~long-haul' ELSE '~global' END AS band, CASE region_code {_CITY} ELSE region_code END AS city
 FROM (SELECT *, regexp_extract(sni, 's3\\.([a-z0-9-]+)\\.amazonaws', 1) AS region_code FROM conns)""",
    "prj15_classify_request": f"WITH {S.WEBLOG} SELECT page_id, {_classify('method', 'path', 'query')} AS s3_op FROM weblog",
    "prj16_resolve_bucket_key": f"""WITH {S.WEBLOG}, a AS (SELECT *, {_HOST} AS h FROM weblog),
 b AS (SELECT *, CASE WHEN ends_with(lower(rtrim(h, '.')), '.amazonaws.com') AND regexp_extract(h, '(?i)^(.+)\\.s3[.-]', 1) <> ''
   THEN regexp_extract(h, '(?i)^(.+)\\.s3[.-]', 1) END AS virt,
   ((regexp_matches(lower(h), '^s3[.-]') AND ends_with(lower(rtrim(h, '.')), '.amazonaws.com')) OR lower(h) IN ('example.com', 'minio.local')) AS pstyle,
   CASE WHEN regexp_matches(lower(h), '.\\.example\\.com$') THEN left(h, length(h) - 12)
        WHEN regexp_matches(lower(h), '.\\.minio\\.local$') THEN left(h, length(h) - 12) END AS sub,
   regexp_replace(path, '^/', '') AS tail FROM a),
 c AS (SELECT *, CASE WHEN virt IS NOT NULL THEN 'virtual' WHEN pstyle THEN 'path' WHEN sub IS NOT NULL THEN 'sub' ELSE 'none' END AS style,
   regexp_extract(tail, '^([^/]+)/', 1) AS first FROM b),
 f AS (SELECT *, CASE WHEN style = 'path' THEN CASE WHEN first <> '' THEN substr(path, length(first) + 2) ELSE '/' END ELSE path END AS kp FROM c)
 SELECT page_id, CASE WHEN style <> 'none' THEN {_classify('method', 'kp', 'query')} END AS s3_op,
 CASE style WHEN 'virtual' THEN virt WHEN 'sub' THEN sub WHEN 'path' THEN CASE WHEN first <> '' THEN first WHEN tail <> '' AND NOT contains(tail, '/') THEN tail END END AS bucket,
 CASE WHEN regexp_replace(kp, '^/', '') <> '' THEN regexp_replace(kp, '^/', '') END AS object_key, style <> 'none' AS is_s3 FROM f""",
    "prj17_region_from_host": f"WITH {S.WEBLOG}, a AS (SELECT page_id, {_HOST} AS h FROM weblog) SELECT page_id, {REGION_SQL} AS region FROM a",
    "prj18_redact": f"""WITH {S.WEBLOG}, a AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'log: ' || method ELSE method END || ' ' || path || '?' || query || '&X-Amz-Expires=60 HTTP/1.1' AS line, method, query FROM weblog)
 SELECT page_id, CASE WHEN page_id % 10 = 3 THEN regexp_replace(line, '(?i)(x-amz-signature=|x-amz-credential=|x-amz-security-token=|signature=|awsaccesskeyid=|expires=)[^& \t]*', '\\1REDACTED', 'g')
 ELSE method || ' /<key>?' || array_to_string(list_transform(string_split(query || '&X-Amz-Expires=60', '&'), lambda p: {_PAIR}), '&') || ' HTTP/1.1' END AS line FROM a""",
    "prj19_keyed_hash": _OPS + f"SELECT op_id, 'sha256:' || sha256({_OPAD} || unhex(sha256({_IPAD} || encode(key_hash)))) AS hashed FROM ops",
    "prj20_sanitize": f"""WITH a AS (SELECT source || CASE doc_id % 3 WHEN 0 THEN chr(8203) WHEN 1 THEN chr(8238) ELSE '' END AS t, text FROM documents),
 b AS (SELECT regexp_replace(t, '{C.UNSAFE_TERM_CLASS}', chr(65533), 'g') AS term, regexp_replace(text, '{C.UNSAFE_TERM_CLASS}', chr(65533), 'g') AS s, text FROM a)
 SELECT term, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(s, chr(65533), ''))) AS BIGINT) AS replaced FROM b GROUP BY 1""",
    "prj21_normalize_endpoint": f"""WITH {S.CONNS}, a AS (SELECT sock_cookie, CASE WHEN pid % 3 = 0 THEN endpoint_ip WHEN pid % 3 = 1 THEN '10.0.0.' || CAST(pid + 16 AS VARCHAR)
 WHEN pid = 2 THEN '2001:db8::1' ELSE endpoint_ip END AS ip FROM conns) SELECT sock_cookie, ip, CASE WHEN contains(ip, ':') THEN 'inet6' ELSE 'inet' END AS family FROM a""",
    "prj22_sentinels": f"""WITH {S.CONNS}, a AS (SELECT *, coalesce(busy_jiffies, 0) + coalesce(rwnd_limited_jiffies, 0) + coalesce(sndbuf_limited_jiffies, 0) AS s FROM conns)
 SELECT sock_cookie, nullif(srtt_us, 0) AS srtt_us, min_rtt_us, CASE WHEN s <> 0 THEN coalesce(busy_jiffies, 0) END AS busy_jiffies,
 CASE WHEN s <> 0 THEN coalesce(rwnd_limited_jiffies, 0) END AS rwnd_limited_jiffies, CASE WHEN s <> 0 THEN coalesce(sndbuf_limited_jiffies, 0) END AS sndbuf_limited_jiffies FROM a""",
}
