"""Captures: tagged JSON lines to typed record tables, with every line accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import counted
from tidemark.sources import schemas as S

MAX_U64 = 18_446_744_073_709_551_615


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


#: Files of a micro-batch for each task that can run at once, where none are named.
FILES_A_TASK = 4


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same lines as a stream; ``classify`` and ``records`` work on it unchanged.

    A compressed file is read by one task, so a micro-batch of fewer files than tasks leaves cores idle: unless ``max_files`` says
    otherwise, it takes some for every task that can run at once.
    """
    return spark.readStream.option("maxFilesPerTrigger", max_files or FILES_A_TASK * spark.sparkContext.defaultParallelism).text(path)


def record_kind(tag: Column, namespace: str | None = None) -> Column:
    """operation / connection / sample for a known tag. ``namespace`` pins the tag's prefix;
    without it any producer's records of these versions are read."""
    out = F.lit(None).cast("string")
    for suffix, kind in S.KIND_TAGS.items():
        hit = tag == f"{namespace}.{suffix}" if namespace else F.substring_index(tag, ".", -1) == suffix
        out = F.when(hit, kind).otherwise(out)
    return out


def _u64(c: Column) -> Column:
    return c.rlike("^[0-9]{1,20}$") & (c.try_cast("decimal(20,0)") <= F.lit(str(MAX_U64)).cast("decimal(20,0)"))


def parse_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later filters must not re-evaluate.

    A filter on parsed fields would be pushed below the projection and parse the line once
    per mention; a one-element generator keeps the parse in one place.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select("*", one.alias("_once")).select(*df.columns, "_once.*")


def classify(lines: DataFrame, namespace: str | None = None, max_line_bytes: int | None = None) -> DataFrame:
    """Add ``outcome`` (a record kind, bad, unknown or blank) and one parsed struct per kind.

    One scan: the tag is sniffed from the text and only the matching struct is decoded.
    Numbers where a record's own field must be a decimal string are bad, as are lines that are not UTF-8 or longer
    than ``max_line_bytes``, if given. Fields of unknown objects inside a record are not looked at.
    """
    value = F.trim("value")
    usable = F.is_valid_utf8("value")
    if max_line_bytes is not None:
        usable = usable & (F.octet_length("value") <= max_line_bytes)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    sniffed = {"_usable": usable, "_tag": F.when(usable, F.get_json_object("value", "$.schema")), "_tree": F.when(usable, F.try_parse_json("value"))}
    df = parse_once(lines, sniffed).withColumn("_kind", record_kind(F.col("_tag"), namespace))
    parsed = {
        name: F.when(F.col("_kind") == name, F.from_json("value", f"{ddl}, _corrupt STRING", opts)) for name, ddl in S.SCHEMAS.items()
    }
    wrong_type = F.lit(False)
    for f in S.DECIMAL_STRINGS:
        kind_of = F.schema_of_variant(F.try_variant_get("_tree", f"$.{f}", "variant"))
        wrong_type = wrong_type | F.coalesce(~kind_of.isin("STRING", "VOID"), F.lit(False))
    is_object = F.col("_tree").isNotNull() & value.startswith("{")
    df = parse_once(
        df,
        {
            **parsed,
            "_numeric": F.when(F.col("_kind").isNotNull(), wrong_type),
            "_object": F.when(F.col("_usable") & F.col("_kind").isNull(), is_object),
        },
    )
    numeric = F.coalesce("_numeric", F.lit(False))
    sound = F.lit(False)
    for name, ddl in S.SCHEMAS.items():
        ok = F.col(name).isNotNull() & F.col(name)["_corrupt"].isNull() & ~numeric
        for f in S.REQUIRED[name]:
            ok = ok & F.col(f"{name}.{f}").isNotNull()
        for f in S.DECIMAL_STRINGS:
            if f"{f} STRING" in ddl:
                c = F.col(f"{name}.{f}")
                ok = ok & (c.isNull() | _u64(c))
        if name == "operation":
            ok = ok & F.col("operation.delimitation").isin("clean", "ambiguous")
        sound = F.when(F.col("_kind") == name, ok).otherwise(sound)
    outcome = (
        F.when(value == "", "blank")
        .when(~F.col("_usable"), "bad")
        .when(F.col("_kind").isNotNull(), F.when(sound, F.col("_kind")).otherwise("bad"))
        .when(F.col("_object"), "unknown")
        .otherwise("bad")
    )
    return parse_once(df, {"outcome": outcome}).drop("_kind", "_tag", "_tree", "_usable", "_numeric", "_object")


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Clock and lifetime to BIGINT; the cookie stays text for joins."""
    out = df.where(F.col("outcome") == name).select(f"{name}.*").drop("_corrupt", "schema")
    for c in ("ts_ns", "lifetime_ns"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("bigint"))
    return out


def operations(classified: DataFrame) -> DataFrame:
    return _typed(classified, "operation").select(
        "*", F.col("app.pid").alias("pid"), F.col("dns.latency_ns").alias("dns_latency_ns"), F.col("dns.cache_hit").alias("dns_cache_hit")
    )


def connections(classified: DataFrame) -> DataFrame:
    return _typed(classified, "connection").select(
        "*", F.col("app.pid").alias("pid"), "endpoint.region", "endpoint.endpoint_ip", "endpoint.via_vpce", "endpoint.cross_region", "tls.sni",
        F.col("tls.version").alias("tls_version"), F.col("tls.cipher").alias("tls_cipher"), F.col("tls.handshake_ns").alias("tls_handshake_ns"),
    )


def samples(classified: DataFrame) -> DataFrame:
    return _typed(classified, "sample")


def counts() -> list[Column]:
    """Records per kind, bad lines and unknown tags; nothing is dropped silently."""
    o = F.col("outcome")
    return [
        *[F.count_if(o == k).alias(f"{k}s") for k in S.SCHEMAS],
        F.count_if(o == "bad").alias("bad_lines"),
        F.count_if(o == "unknown").alias("unknown_schema"),
    ]


def accounting(classified: DataFrame) -> DataFrame:
    """One row: the counts of all lines."""
    return classified.agg(*counts())


def load(classified: DataFrame, kind: str = "operation") -> tuple[DataFrame, dict[str, int]]:
    """The records of a kind, stored, and the counts of all lines, taken by the pass that stores them."""
    return counted(classified, counts(), lambda df: _typed(df, kind), kind)


class NoRecords(ValueError):
    """A capture without usable records is a tool failure, never a clean pass."""


def require_records(classified: DataFrame, kinds: tuple[str, ...] = ("operation", "connection", "sample")) -> DataFrame:
    """Return the input, or raise saying whether it was empty, junk or wrongly tagged."""
    if classified.where(F.col("outcome").isin(list(kinds))).limit(1).isEmpty():
        n = accounting(classified).first()
        if n.bad_lines + n.unknown_schema == 0:
            why = "the input is empty"
        elif n.unknown_schema:
            why = f"{n.unknown_schema} objects carry an unknown tag and {n.bad_lines} lines are not records"
        else:
            why = f"none of {n.bad_lines} lines is a record"
        raise NoRecords(f"no usable records: {why}")
    return classified
