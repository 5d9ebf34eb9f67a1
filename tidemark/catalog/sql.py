"""DuckDB texts of the re-shaped tables, inlined as CTEs by the reference SQL."""

OPS = """
e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS ts_ns,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ops AS (SELECT CAST(event_id AS VARCHAR) AS op_id, ts_ns, CAST(user_id AS VARCHAR) AS sock_cookie, user_id % 8 AS pid,
 CASE event_type WHEN 'click' THEN 'HEAD' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS verb,
 CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'error' THEN 'GetObject' WHEN 'click' THEN 'HeadObject'
      WHEN 'purchase' THEN 'PutObject' ELSE 'ListObjectsV2' END AS s3_op,
 CASE WHEN k % 10 = 9 THEN NULL ELSE 'b' || CAST(user_id % 5 AS VARCHAR) END AS bucket,
 'k' || CAST(k AS VARCHAR) AS key_hash,
 CASE WHEN k = 99 THEN NULL WHEN event_type <> 'error' THEN 200 WHEN k % 5 = 0 THEN 503 WHEN k % 5 = 1 THEN 500
      WHEN k % 5 = 2 THEN 404 WHEN k % 5 = 3 THEN 403 ELSE 400 END AS http_status,
 CAST(round(value * 1000000) AS BIGINT) AS ttfb_ns,
 CASE WHEN event_type = 'view' THEN CAST(round(value * 2000000) AS BIGINT) END AS download_ns,
 CAST(round(value * 10000000000) AS BIGINT) AS total_ns,
 CASE WHEN k % 7 <> 0 THEN CAST((k + 1) * 4096 AS BIGINT) END AS content_length,
 CASE WHEN k % 5 <> 0 THEN CAST((k + 1) * 4096 + 512 AS BIGINT) END AS op_bytes_recv,
 CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN CAST(round(value * 300000) AS BIGINT) END AS tcp_connect_ns,
 CASE WHEN k % 15 = 0 THEN CAST(round(value * 50000) AS BIGINT) END AS tls_handshake_ns,
 CASE WHEN k % 6 = 0 THEN CAST(round(value * 100000) AS BIGINT) END AS dns_latency_ns,
 CASE WHEN k % 6 = 0 THEN k % 4 = 0 END AS dns_cache_hit,
 CASE WHEN k % 2 = 1 THEN 'req-' || CAST(event_id AS VARCHAR) END AS aws_request_id,
 k % 3 <> 0 AS connection_reused, k % 20 = 7 AS partial,
 CASE WHEN k % 25 = 3 THEN 'ambiguous' ELSE 'clean' END AS delimitation FROM e),
opf AS (SELECT *, coalesce(http_status, 0) < 400 AND NOT partial AND delimitation = 'clean' AS elig,
 coalesce(http_status, 0) < 400 AND NOT partial AND delimitation = 'clean' AND http_status IS NOT NULL AS good,
 CASE WHEN http_status IS NULL THEN NULL WHEN http_status IN (429, 503) THEN 'throttle' WHEN http_status = 403 THEN 'forbidden'
      WHEN http_status = 404 THEN 'not_found' WHEN http_status = 400 THEN 'bad_request'
      WHEN http_status BETWEEN 400 AND 499 THEN 'client' WHEN http_status >= 500 THEN 'server' ELSE 'success' END AS cls
 FROM ops)
"""

CONNS = """
conns AS (SELECT CAST(c_custkey AS VARCHAR) AS sock_cookie, c_custkey % 8 AS pid, lower(r_name) AS region,
 '10.0.0.' || CAST(n_nationkey AS VARCHAR) AS endpoint_ip, n_nationkey % 10 = 9 AS cross_region, n_nationkey % 5 = 4 AS via_vpce,
 'b' || CAST(c_custkey % 5 AS VARCHAR) || '.s3.eu-west-' || CAST(n_regionkey AS VARCHAR) || '.amazonaws.com' AS sni,
 CAST(c_custkey * 1000 AS BIGINT) AS ts_ns,
 CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1000 * (1 + n_regionkey) + c_custkey % 997 END AS BIGINT) AS srtt_us,
 CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 900 * (1 + n_regionkey) END AS BIGINT) AS min_rtt_us,
 CAST(CASE WHEN c_custkey % 7 <> 0 THEN 100 + c_custkey % 3800 END AS BIGINT) AS rttvar_us,
 CAST(abs(round(c_acctbal)) AS BIGINT) * 100 AS bytes_sent,
 CAST(abs(round(c_acctbal)) AS BIGINT) * (c_custkey % 5) * 100 AS bytes_recv,
 CAST(c_custkey % 3 AS BIGINT) AS retransmits, CAST((c_custkey % 3) * 1460 AS BIGINT) AS bytes_retrans,
 CASE WHEN c_custkey % 6 <> 0 THEN CAST((500 + c_custkey % 977) * 1000 AS BIGINT) END AS tls_handshake_ns,
 CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'TLSv1.2' ELSE 'TLSv1.3' END AS tls_version,
 CASE WHEN c_custkey % 5 <> 0 THEN CAST(4865 + c_custkey % 3 AS INTEGER) END AS tls_cipher,
 CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 50 AS BIGINT) END AS busy_jiffies,
 CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 7 AS BIGINT) END AS rwnd_limited_jiffies,
 CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 3 AS BIGINT) END AS sndbuf_limited_jiffies,
 CASE WHEN c_custkey % 40 <> 0 THEN CAST(c_custkey % 40 AS BIGINT) END AS snd_cwnd,
 CASE WHEN c_custkey % 10 <> 0 THEN CAST(1460 AS BIGINT) END AS mss,
 CASE WHEN c_custkey % 8 <> 0 THEN CAST((c_custkey % 1000) * 20000 AS BIGINT) END AS delivery_rate_bps,
 CASE WHEN c_custkey % 2 = 0 THEN true END AS app_limited,
 CAST(65536 * (1 + c_custkey % 4) AS BIGINT) AS window_clamp,
 CAST((1 + c_custkey % 100) * 100000000 AS BIGINT) AS lifetime_ns,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(3 + c_custkey % 3 AS BIGINT) END AS reordering,
 CASE WHEN c_custkey % 50 = 0 THEN 3 END AS ca_state,
 CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 4 AS BIGINT) END AS rcv_ooopack,
 CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 6 AS BIGINT) END AS dsack_dups,
 CASE WHEN c_custkey % 2 = 0 THEN 'p0' ELSE 'p1' END AS provider, c_mktsegment AS tier
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
connf AS (SELECT *, CASE WHEN srtt_us > 0 AND srtt_us < 30000000 THEN CAST(srtt_us AS DOUBLE) END AS live_srtt,
 CASE WHEN min_rtt_us > 0 AND min_rtt_us < 30000000 THEN CAST(min_rtt_us AS DOUBLE) END AS live_min,
 coalesce(CASE WHEN srtt_us > 0 AND srtt_us < 30000000 THEN CAST(srtt_us AS DOUBLE) END,
          CASE WHEN min_rtt_us > 0 AND min_rtt_us < 30000000 THEN CAST(min_rtt_us AS DOUBLE) END) AS floor_us,
 bytes_sent > bytes_recv AND bytes_sent >= 65536 AS send_heavy, bytes_recv > bytes_sent AND bytes_recv >= 65536 AS recv_heavy
 FROM conns)
"""

SAMPLES = """
li AS (SELECT CAST(l_suppkey AS VARCHAR) AS sock_cookie,
 (epoch_us(l_shipdate) // 86400000000) * 100000000 + (l_orderkey * 7919 + l_linenumber * 104729) % 100000000 AS ts_ns,
 year(l_shipdate) AS epoch, l_suppkey % 2 = 0 AS down, CAST(round(l_extendedprice) AS BIGINT) AS big,
 CAST(round(l_quantity) AS BIGINT) AS qty, l_tax, l_discount, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
sr AS (SELECT *, CAST(sum(big) OVER w AS BIGINT) AS r_big, CAST(sum(qty * 10) OVER w AS BIGINT) AS r_small,
 CAST(sum(qty % 3) OVER w AS BIGINT) AS r_ret, CAST(sum(l_linenumber % 4) OVER w AS BIGINT) AS r_ooo FROM li
 WINDOW w AS (PARTITION BY sock_cookie, epoch ORDER BY ts_ns, l_orderkey, l_linenumber, l_partkey, l_extendedprice
              ROWS UNBOUNDED PRECEDING)),
samples AS (SELECT sock_cookie, ts_ns, CASE WHEN down THEN r_big ELSE r_small END AS bytes_recv,
 CASE WHEN down THEN r_small ELSE r_big END AS bytes_sent, r_ret AS total_retrans, r_ooo AS rcv_ooopack,
 CAST(round(l_tax * 100000) + 1000 AS BIGINT) AS srtt_us,
 CASE WHEN qty % 11 <> 0 THEN CAST(1000 + qty * 10 AS BIGINT) END AS min_rtt_us,
 CASE WHEN qty % 4 <> 0 THEN big * 10 END AS delivery_rate_bps, l_discount > 0.08 AS rate_app_limited,
 10 + qty AS snd_cwnd, CAST(65536 + l_linenumber * 1000 AS BIGINT) AS rcv_wnd,
 l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM sr)
"""

TRACE = OPS + """,
kinds AS (SELECT *, CASE s3_op WHEN 'GetObject' THEN 'get' WHEN 'HeadObject' THEN 'head' WHEN 'PutObject' THEN 'put' ELSE 'other' END
 AS kind FROM ops),
trace AS (SELECT ts_ns, op_id, CASE WHEN kind <> 'get' THEN kind WHEN http_status = 200 THEN 'get' WHEN http_status = 206 THEN 'other' END
 AS op, bucket || '/' || key_hash AS object_id, content_length AS size, http_status AS status, pid AS app FROM kinds
 WHERE (NOT partial OR s3_op = 'PutObject') AND bucket IS NOT NULL
  AND (kind <> 'get' OR http_status IN (200, 206)))
"""

WEBLOG = """
w0 AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site,
 regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS url_path, regexp_extract(url, '[?]([^#]*)', 1) AS url_query FROM pages),
weblog AS (SELECT page_id,
 CASE page_id % 7 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'PUT' WHEN 2 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'GET' END AS method,
 CASE WHEN page_id % 11 = 0 THEN '/' WHEN url_path = '' THEN '/' ELSE url_path END AS path,
 CASE page_id % 9 WHEN 0 THEN 'list-type=2&prefix=x' WHEN 1 THEN 'uploads' WHEN 2 THEN 'uploadId=u1&partNumber=3'
      WHEN 3 THEN 'delete' WHEN 4 THEN 'session' WHEN 5 THEN 'X-Amz-Signature=abc&versionId=v1' ELSE url_query END AS query,
 CASE page_id % 8 WHEN 0 THEN split_part(site, '.', 2) || '.s3.us-west-2.amazonaws.com'
      WHEN 1 THEN 's3.dualstack.eu-central-1.amazonaws.com:443' WHEN 2 THEN 'Data.' || split_part(site, '.', 1) || '.S3-ap-south-1.amazonaws.com'
      WHEN 3 THEN 's3.amazonaws.com' WHEN 4 THEN 'example.com:9000' WHEN 5 THEN 'x.s3.amazonaws.com.' ELSE site END AS host FROM w0)
"""


def mid(x: str, cond: str = "true") -> str:
    """Mean of the middle two."""
    c = f"{x} IS NOT NULL AND ({cond})"
    s = f"list_sort(list({x}) FILTER (WHERE {c}))"
    n = f"count(*) FILTER (WHERE {c})"
    return f"(({s})[({n} + 1) // 2] + ({s})[{n} // 2 + 1]) / 2.0"


def upper(x: str, cond: str = "true") -> str:
    c = f"{x} IS NOT NULL AND ({cond})"
    return f"(list_sort(list({x}) FILTER (WHERE {c})))[count(*) FILTER (WHERE {c}) // 2 + 1]"


def pct(x: str, p: float, cond: str = "true") -> str:
    c = f"{x} IS NOT NULL AND ({cond})"
    n = f"count(*) FILTER (WHERE {c})"
    return f"(list_sort(list({x}) FILTER (WHERE {c})))[CAST(greatest(1, ceil({p} * {n})) AS BIGINT)]"
