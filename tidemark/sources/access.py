"""Access traces in three line formats, detected per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.session import counted
from tidemark.sources import schemas as S
from tidemark.sources.capture import parse_once, record_kind

OUT = ["ts_ns", "op", "object_id", "range_start", "range_end", "size", "status"]


def classify_access(lines: DataFrame, namespace: str | None = None) -> DataFrame:
    """Add outcome (event, operation_dropped, other_record, unusable, blank) and the event fields.

    A tagged request record passes the demand gates, a normalised JSON event is taken as is,
    and anything else may be a text line ``<ms> REST.VERB.RESOURCE <id> [size] [start end]``.
    """
    v = F.col("value")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    df = parse_once(lines, {"_tag": F.get_json_object(v, "$.schema")}).withColumn("_kind", record_kind(F.col("_tag"), namespace))
    df = parse_once(
        df,
        {
            "_o": F.when(F.col("_kind") == "operation", F.from_json(v, f"{S.OPERATION}, _corrupt STRING", opts)),
            "_e": F.when(F.col("_tag").isNull() & v.startswith("{"), F.from_json(v, f"{S.ACCESS}, _corrupt STRING", opts)),
            "_t": F.when(F.col("_tag").isNull() & ~F.ltrim(v).startswith("{"), F.split(F.trim(v), r"\s+")),
        },
    )
    kind = C.op_kind(F.col("_o.s3_op"), F.col("_o.verb"))
    op = F.struct(
        F.col("_o.ts_ns").try_cast("bigint").alias("ts_ns"),
        C.demand_op(kind, F.col("_o.http_status")).alias("op"),
        C.object_id(F.col("_o.bucket"), F.col("_o.key_hash")).alias("object_id"),
        F.lit(None).cast("bigint").alias("range_start"), F.lit(None).cast("bigint").alias("range_end"),
        F.col("_o.content_length").alias("size"), F.col("_o.http_status").alias("status"),
    )
    ev = F.struct(
        "_e.ts_ns", "_e.op", "_e.object_id", F.try_element_at("_e.range", F.lit(1)).alias("range_start"),
        F.try_element_at("_e.range", F.lit(2)).alias("range_end"), "_e.size", "_e.status",
    )
    t = lambda i: F.get("_t", F.lit(i))
    num = lambda i: t(i).try_cast("bigint")
    req = F.split(F.regexp_extract(t(1), r"^REST\.(.*)$", 1), r"\.")
    verb, on_object = F.get(req, F.lit(0)), F.coalesce(F.get(req, F.lit(1)).isin("OBJECT", "PART"), F.lit(False))
    text_op = (
        F.when(~t(1).startswith("REST."), None)
        .when((verb == "GET") & on_object, "get")
        .when((verb == "HEAD") & on_object, "head")
        .when(verb.isin("PUT", "POST", "COPY"), "put")
        .when(verb == "DELETE", "delete")
        .otherwise("other")
    )
    spanned = num(5) >= num(4)
    text = F.struct(
        (num(0) * 1_000_000).alias("ts_ns"), text_op.alias("op"), t(2).alias("object_id"),
        F.when(spanned, num(4)).when(num(3) > 0, F.lit(0)).alias("range_start"),
        F.when(spanned, num(5)).when(num(3) > 0, num(3) - 1).alias("range_end"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("int").alias("status"),
    )
    whole = lambda s: s["ts_ns"].isNotNull() & s["op"].isNotNull() & s["object_id"].isNotNull()
    ops_ok = F.col("_o").isNotNull() & F.col("_o._corrupt").isNull()
    ev_ok = F.col("_e").isNotNull() & F.col("_e._corrupt").isNull() & F.col("_e.op").isin("get", "head", "put", "delete", "other")
    outcome = (
        F.when(F.trim(v) == "", "blank")
        .when((F.col("_kind") == "operation") & ~ops_ok, "unusable")
        .when((F.col("_kind") == "operation") & (F.coalesce(F.col("_o.partial"), F.lit(False)) | ~whole(op)), "operation_dropped")
        .when(F.col("_kind") == "operation", "event")
        .when(F.col("_kind").isNotNull(), "other_record")
        .when(F.col("_tag").isNotNull(), "unusable")
        .when(ev_ok & whole(ev), "event")
        .when(F.col("_t").isNotNull() & whole(text), "event")
        .otherwise("unusable")
    )
    chosen = F.when(F.col("_kind") == "operation", op).when(F.col("_e").isNotNull(), ev).otherwise(text)
    return (
        parse_once(df, {"outcome": outcome, "_x": chosen})
        .drop("_tag", "_kind", "_o", "_e", "_t")
        .select("*", *[F.when(F.col("outcome") == "event", F.col(f"_x.{c}")).alias(c) for c in OUT])
        .drop("_x")
    )


def events(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == "event").drop("outcome", "value")


def counts() -> list[Column]:
    """'No usable reads' stays apart from 'not a trace at all'."""
    o = F.col("outcome")
    return [
        F.count_if(o == "event").alias("events"),
        F.count_if(o.isin("operation_dropped", "other_record", "unusable")).alias("skipped"),
        F.count_if(o == "operation_dropped").alias("operations_dropped"),
        F.count_if(o == "other_record").alias("other_records"),
    ]


def load_accounting(classified: DataFrame) -> DataFrame:
    """One row: the counts of all lines."""
    return classified.agg(*counts())


def load(classified: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The events of a trace, stored, and the counts of all its lines, taken by the pass that stores them."""
    return counted(classified, counts(), events, "trace")
