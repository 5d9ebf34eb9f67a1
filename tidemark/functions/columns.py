"""Column predicates, classifications and projections shared by every judgment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config

# Operations that change an object.
WRITE_OPS = ["PutObject", "UploadPart", "CompleteMultipartUpload", "DeleteObject"]

# Price per 1,000 requests by operation-name prefix (USD).
FREE_PREFIXES = ["Delete", "Abort"]
TIER1_PREFIXES = ["Put", "Post", "Copy", "List", "Create", "Upload", "Complete"]
TIER1_USD_PER_1K = 0.005
TIER2_USD_PER_1K = 0.0004

# City shown for a region code.
REGION_CITIES = {
    "us-east-1": "N. Virginia",
    "us-west-2": "Oregon",
    "eu-west-1": "Ireland",
    "eu-central-1": "Frankfurt",
    "ap-southeast-1": "Singapore",
    "ap-northeast-1": "Tokyo",
    "ap-south-1": "Mumbai",
    "sa-east-1": "São Paulo",
}

# Code points that must not reach a group key or a terminal (controls,
# format characters, line and paragraph separators).
UNSAFE_TERM_CLASS = (
    r"[\p{Cc}\x{00AD}\x{0600}-\x{0605}\x{061C}\x{06DD}\x{070F}\x{0890}-\x{0891}\x{08E2}\x{180E}"
    r"\x{200B}-\x{200F}\x{2028}-\x{2029}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
    r"\x{FFF9}-\x{FFFB}\x{110BD}\x{110CD}\x{13430}-\x{1343F}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}"
    r"\x{E0001}\x{E0020}-\x{E007F}]"
)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return cond


def eligible() -> Column:
    """A request whose latency may be judged: no error status, whole, cleanly delimited."""
    return (F.coalesce(F.col("http_status"), F.lit(0)) < 400) & ~F.col("partial") & (
        F.col("delimitation") == "clean"
    )


def timeable() -> Column:
    """Eligible and answered; aborted requests never enter a latency."""
    return eligible() & F.col("http_status").isNotNull()


def status_class(c: Column) -> Column:
    """success / throttle / 403 / 404 / 400 / client / server; NULL when unanswered."""
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.isin(429, 503), "throttle")
        .when(c == 403, "forbidden")
        .when(c == 404, "not_found")
        .when(c == 400, "bad_request")
        .when((c >= 400) & (c < 500), "client")
        .when(c >= 500, "server")
        .otherwise("success")
    )


def price_tier(op: Column) -> Column:
    return (
        F.when(op.isNull(), F.lit(None).cast("string"))
        .when(starts_with_any(op, FREE_PREFIXES), "free")
        .when(starts_with_any(op, TIER1_PREFIXES), "tier-1")
        .otherwise("tier-2")
    )


def price_per_1k(tier: Column) -> Column:
    return F.when(tier == "free", 0.0).when(tier == "tier-1", TIER1_USD_PER_1K).when(
        tier == "tier-2", TIER2_USD_PER_1K
    )


def usable_rtt(c: Column, cfg: Config = DEFAULT) -> Column:
    """0 means never sampled; implausibly large is a sentinel or corrupt."""
    return F.when((c > 0) & (c < cfg.max_plausible_rtt_us), c)


def conn_floor_us(cfg: Config = DEFAULT) -> Column:
    return F.coalesce(usable_rtt(F.col("srtt_us"), cfg), usable_rtt(F.col("min_rtt_us"), cfg)).cast("double")


def send_heavy(cfg: Config = DEFAULT) -> Column:
    return (F.col("bytes_sent") > F.col("bytes_recv")) & (F.col("bytes_sent") >= cfg.min_directional_bytes)


def recv_heavy(cfg: Config = DEFAULT) -> Column:
    return (F.col("bytes_recv") > F.col("bytes_sent")) & (F.col("bytes_recv") >= cfg.min_directional_bytes)


def op_kind(s3_op: Column, verb: Column) -> Column:
    """get / head / put / delete / other; the verb counts only when no operation is named."""
    by_op = (
        F.when(s3_op == "GetObject", "get")
        .when(s3_op == "HeadObject", "head")
        .when(
            s3_op.isin("PutObject", "UploadPart", "CreateMultipartUpload", "CompleteMultipartUpload", "CopyObject"),
            "put",
        )
        .when(s3_op.isin("DeleteObject", "DeleteObjects", "AbortMultipartUpload"), "delete")
        .otherwise("other")
    )
    by_verb = (
        F.when(verb == "GET", "get")
        .when(verb == "HEAD", "head")
        .when(verb == "PUT", "put")
        .when(verb == "DELETE", "delete")
        .otherwise("other")
    )
    return F.when(s3_op.isNotNull(), by_op).otherwise(by_verb)


def demand_op(kind: Column, status: Column) -> Column:
    """A read counts only when a whole body was served; ranged reads are kept as other;
    any other read is dropped (NULL). Everything else passes whatever its status."""
    return (
        F.when(kind != "get", kind)
        .when(status == 200, "get")
        .when(status == 206, "other")
    )


def object_id(bucket: Column, key: Column) -> Column:
    """NULL unless both parts are known."""
    return F.concat(bucket, F.lit("/"), key)


def fill_key(c: Column) -> Column:
    """A non-null stand-in for a nullable grouping key that no real value equals."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("="), c))


def unfill_key(c: Column) -> Column:
    return F.when(c != "-", F.substring(c, 2, 1_000_000))


def sanitize_term(c: Column) -> Column:
    """Replace unsafe code points by U+FFFD so spoofed names group together."""
    return F.regexp_replace(c, UNSAFE_TERM_CLASS, "�")


def distance_band(ms: Column) -> Column:
    return (
        F.when(ms < 5, "~in-region").when(ms < 40, "~regional").when(ms < 100, "~long-haul").when(ms.isNotNull(), "~global")
    )


def region_city(code: Column) -> Column:
    out = code
    for region, city in REGION_CITIES.items():
        out = F.when(code == region, city).otherwise(out)
    return out


def path_stability(floor_ms: Column, jitter_ms: Column) -> Column:
    return F.when(
        (jitter_ms > 2.0) & ((jitter_ms > 0.15 * floor_ms) | (jitter_ms > 15.0)), "variable path"
    ).when(jitter_ms.isNotNull(), "steady")


def null_if(c: Column, *sentinels: int) -> Column:
    """Raw-counter sentinel values mean 'not observed'."""
    return F.when(~c.isin(*sentinels), c)


def request_flags() -> Column:
    """P(artial) A(mbiguous) C(ached resolve)."""
    return F.concat_ws(
        "",
        F.when(F.col("partial"), "P"),
        F.when(F.col("delimitation") == "ambiguous", "A"),
        F.when(F.col("dns_cache_hit"), "C"),
    )


def normalize_ip(ip: Column) -> Column:
    """IPv4-mapped IPv6 addresses collapse to IPv4, in dotted or in hex-group form."""
    low = F.lower(ip)
    dotted = F.regexp_extract(low, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    hi = F.regexp_extract(low, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 1)
    lo = F.regexp_extract(low, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 2)
    h, l = F.conv(hi, 16, 10).cast("int"), F.conv(lo, 16, 10).cast("int")
    quad = F.concat_ws(
        ".", F.shiftright(h, 8).cast("string"), h.bitwiseAND(255).cast("string"),
        F.shiftright(l, 8).cast("string"), l.bitwiseAND(255).cast("string"),
    )
    return F.when(dotted != "", dotted).when(hi != "", quad).otherwise(ip)


def ip_family(ip: Column) -> Column:
    return F.when(ip.contains(":"), "inet6").when(ip.isNotNull(), "inet")
