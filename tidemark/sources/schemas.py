"""Record types. Fixed and versioned, never inferred; unknown fields are ignored."""

from __future__ import annotations

# Record kinds by the part of the tag after its namespace.
KIND_TAGS = {"operation/1": "operation", "connection/2": "connection", "sample/1": "sample"}
FINDING_TAG = "finding/1"
SCORECARD_TAG = "scorecard/1"

DNS = "STRUCT<latency_ns: BIGINT, cache_hit: BOOLEAN, resolved_ip: STRING, n_answers: INT, ttl_s: BIGINT, via: STRING>"

OPERATION = f"""schema STRING, emitted_at STRING, op_id STRING, ts_ns STRING, sock_cookie STRING, req_seq BIGINT, app STRUCT<pid: BIGINT>,
verb STRING, s3_op STRING, bucket STRING, key_hash STRING, dns {DNS}, tcp_connect_ns BIGINT, tls_handshake_ns BIGINT,
tls_version STRING, ttfb_ns BIGINT, download_ns BIGINT, total_ns BIGINT, content_length BIGINT, op_bytes_sent BIGINT,
op_bytes_recv BIGINT, bytes_sent BIGINT, bytes_recv BIGINT, retransmits BIGINT, srtt_us BIGINT, lifetime_ns STRING,
connection_reused BOOLEAN, http_status INT, aws_request_id STRING, partial BOOLEAN, delimitation STRING"""

CONNECTION = f"""schema STRING, emitted_at STRING, ts_ns STRING, sock_cookie STRING, app STRUCT<pid: BIGINT>,
endpoint STRUCT<region: STRING, endpoint_ip: STRING, family: STRING, dport: INT, via_vpce: BOOLEAN, cross_region: BOOLEAN>,
dns {DNS}, tcp_connect_ns BIGINT, connect_failed BOOLEAN,
tls STRUCT<seen: BOOLEAN, handshake_ns: BIGINT, version: STRING, sni: STRING, cipher: INT>,
bytes_sent BIGINT, bytes_recv BIGINT, retransmits BIGINT, srtt_us BIGINT, lifetime_ns STRING, min_rtt_us BIGINT,
rttvar_us BIGINT, snd_cwnd BIGINT, mss BIGINT, delivery_rate_bps BIGINT, busy_jiffies BIGINT, rwnd_limited_jiffies BIGINT,
sndbuf_limited_jiffies BIGINT, lost BIGINT, sacked BIGINT, reordering BIGINT, ca_state INT, rcv_wnd BIGINT, window_clamp BIGINT,
bytes_retrans BIGINT, dsack_dups BIGINT, rcv_ooopack BIGINT, app_limited BOOLEAN, partial BOOLEAN"""

SAMPLE = """schema STRING, emitted_at STRING, ts_ns STRING, sock_cookie STRING, bytes_sent BIGINT, bytes_recv BIGINT,
bytes_in_flight BIGINT, snd_cwnd BIGINT, rcv_wnd BIGINT, snd_wnd BIGINT, total_retrans BIGINT, rcv_ooopack BIGINT, lost BIGINT,
sacked_out BIGINT, ca_state INT, rate_app_limited BOOLEAN, srtt_us BIGINT, min_rtt_us BIGINT, delivery_rate_bps BIGINT"""

ACCESS = "ts_ns BIGINT, op STRING, object_id STRING, range ARRAY<BIGINT>, size BIGINT, version STRING, status INT"

SCHEMAS = {"operation": OPERATION, "connection": CONNECTION, "sample": SAMPLE}
REQUIRED = {
    "operation": [
        "op_id", "sock_cookie", "req_seq", "app.pid", "bytes_sent", "bytes_recv", "retransmits", "connection_reused", "partial", "delimitation",
    ],
    "connection": [
        "sock_cookie", "app.pid", "endpoint.via_vpce", "endpoint.cross_region", "connect_failed", "tls.seen", "bytes_sent", "bytes_recv",
        "retransmits", "partial",
    ],
    "sample": ["sock_cookie", "bytes_sent", "bytes_recv", "snd_cwnd", "rcv_wnd", "total_retrans", "rcv_ooopack", "rate_app_limited"],
}
DECIMAL_STRINGS = ["ts_ns", "sock_cookie", "lifetime_ns"]
