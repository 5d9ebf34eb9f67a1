"""Request classification, endpoint resolution and log hygiene over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys whose values may be shown.
SAFE_QUERY_KEYS = ["versionid", "partnumber", "uploadid", "list-type", "delete", "uploads", "session"]

# Parameters that carry signing secrets.
SIGNING_PARAMETERS = [
    "x-amz-signature=",
    "x-amz-credential=",
    "x-amz-security-token=",
    "signature=",
    "awsaccesskeyid=",
    "expires=",
]

_REGION = r"[a-z]{2}(?:-[a-z]+){1,2}-[0-9]+"
_SUFFIX = ".amazonaws.com"


def query_has(query: Column, key: str) -> Column:
    return query.rlike(rf"(^|&){key}(=|&|$)")


def query_value(query: Column, key: str) -> Column:
    """Value of the first pair named ``key``; empty when it has none or is absent."""
    return F.regexp_extract(query, rf"(?:^|&){key}(?:=([^&]*))?(?:&|$)", 1)


def classify_request(method: Column, path: Column, query: Column) -> Column:
    """One of 13 operation names or UNKNOWN, from the parts of a request line."""
    has_key = F.length(path) > 1
    q = F.coalesce(query, F.lit(""))
    get, put, post, delete = (method == m for m in ("GET", "PUT", "POST", "DELETE"))
    return (
        F.when(get & query_has(q, "session"), "CreateSession")
        .when(get & (query_value(q, "list-type") == "2"), "ListObjectsV2")
        .when(get & ~has_key, "ListObjects")
        .when(get, "GetObject")
        .when((method == "HEAD") & has_key, "HeadObject")
        .when(put & query_has(q, "partNumber") & query_has(q, "uploadId"), "UploadPart")
        .when(put & has_key, "PutObject")
        .when(post & query_has(q, "delete"), "DeleteObjects")
        .when(post & query_has(q, "uploads"), "CreateMultipartUpload")
        .when(post & query_has(q, "uploadId"), "CompleteMultipartUpload")
        .when(delete & query_has(q, "uploadId"), "AbortMultipartUpload")
        .when(delete & has_key, "DeleteObject")
        .otherwise("UNKNOWN")
    )


def host_without_port(host: Column) -> Column:
    bare = F.regexp_extract(host, r"^([^:\[][^:]*):[0-9]+$", 1)
    return F.when(bare != "", bare).otherwise(host)


def _lower_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def bucket_from_host(host: Column) -> Column:
    """Virtual-hosted bucket: what precedes the last .s3. or .s3- label."""
    b = F.regexp_extract(host, r"(?i)^(.+)\.s3[.-]", 1)
    return F.when(_lower_host(host).endswith(_SUFFIX) & (b != ""), b)


def is_service_endpoint(host: Column) -> Column:
    low = _lower_host(host)
    return (low.startswith("s3.") | low.startswith("s3-")) & low.endswith(_SUFFIX)


def _bucket_from_subdomain(host: Column, endpoints: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for ep in reversed(endpoints):
        cut = F.length(host) - len(ep) - 1
        hit = F.lower(host).endswith("." + ep.lower()) & (cut > 0)
        out = F.when(hit, F.substring(host, F.lit(1), cut)).otherwise(out)
    return out


def resolve_request(method: Column, path: Column, query: Column, host: Column, endpoints: list[str] = ()) -> Column:
    """struct(s3_op, bucket, object_key, is_s3): virtual-hosted, path-style or custom endpoint."""
    endpoints = list(endpoints)
    h = host_without_port(host)
    virtual = bucket_from_host(h)
    path_style = F.coalesce(is_service_endpoint(h), F.lit(False))
    if endpoints:
        path_style = path_style | F.coalesce(F.lower(h).isin([e.lower() for e in endpoints]), F.lit(False))
    sub = _bucket_from_subdomain(h, endpoints)
    tail = F.regexp_replace(path, r"^/", "")
    first = F.regexp_extract(tail, r"^([^/]+)/", 1)
    style = (
        F.when(virtual.isNotNull(), "virtual").when(path_style, "path").when(sub.isNotNull(), "sub").otherwise("none")
    )
    key_path = F.when(
        style == "path",
        F.when(first != "", F.substring(path, F.length(first) + 2, F.length(path))).otherwise("/"),
    ).otherwise(path)
    bucket = (
        F.when(style == "virtual", virtual)
        .when((style == "path") & (first != ""), first)
        .when((style == "path") & (tail != "") & ~tail.contains("/"), tail)
        .when(style == "sub", sub)
    )
    key = F.regexp_replace(key_path, r"^/", "")
    return F.struct(
        F.when(style != "none", classify_request(method, key_path, query)).alias("s3_op"),
        bucket.alias("bucket"),
        F.when(key != "", key).alias("object_key"),
        (style != "none").alias("is_s3"),
    )


def region_from_host(host: Column) -> Column:
    """Region named by a service host; the legacy global host means us-east-1."""
    h = F.regexp_replace(host, r"\.+$", "")
    pattern = rf"(?:^|\.)(?:s3\.(?:dualstack\.)?({_REGION})|s3-({_REGION})\.amazonaws)(?:\.|$)"
    named = F.concat(F.regexp_extract(h, pattern, 1), F.regexp_extract(h, pattern, 2))
    return F.when(
        h.endswith(_SUFFIX) | (h == "amazonaws.com"),
        F.when(named != "", named).when(h.rlike(r"(^|\.)s3(\.|$)"), "us-east-1"),
    )


def scrub_query(query: Column) -> Column:
    def one(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        return (
            F.when(~pair.contains("="), pair)
            .when(F.lower(key).isin(SAFE_QUERY_KEYS), pair)
            .otherwise(F.concat(key, F.lit("=REDACTED")))
        )

    return F.array_join(F.transform(F.split(query, "&"), one), "&")


def scrub_signing(line: Column) -> Column:
    names = "|".join(SIGNING_PARAMETERS)
    return F.regexp_replace(line, rf"(?i)({names})[^& \t]*", "$1REDACTED")


def redact_request_line(line: Column) -> Column:
    """Drop the object key and every query value that is not known to be harmless."""
    pattern = r"^([A-Z]{1,16}) ((?:/|https?://)[^ ]*)(?: (.*))?$"
    method = F.regexp_extract(line, pattern, 1)
    target = F.regexp_extract(line, pattern, 2)
    tail = F.regexp_extract(line, pattern, 3)
    query = F.regexp_extract(target, r"\?(.*)$", 1)
    return F.when(
        method != "",
        F.concat(
            method,
            F.lit(" /<key>"),
            F.when(target.contains("?"), F.concat(F.lit("?"), scrub_query(query))).otherwise(""),
            F.when(tail.rlike(r"^HTTP/1\.[^ \t]*$"), F.concat(F.lit(" "), tail)).otherwise(""),
        ),
    ).otherwise(scrub_signing(line))


def keyed_hash(salt: bytes, key: Column) -> Column:
    """``sha256:`` + HMAC-SHA256(salt, key): stable within a capture, unlinkable across."""
    import hashlib

    block = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.sha2(F.concat(inner, F.encode(key, "UTF-8")), 256)
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(outer, F.unhex(digest)), 256))
