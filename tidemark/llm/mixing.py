"""Mixing sources to target weights along a time-varying curriculum, on DataFrame functions alone.

Every source has a target of words and a weight schedule over training time t in [0, 1]. Its schedule's
integral F(t) is the share of its target that is due by t. Its documents lie behind each other on the
source's word axis, in hash order, once per pass; a document that begins at word c is due where
F(t) = c / target, so inverting F gives its training position, and a range sort by position gives the
training order. A target that is not a multiple of the source ends inside a document, which then gives
only its leading words to the last pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's hash that name its slice of the source's word axis: 4096 slices, so that no
#: source is summed or sorted in one task.
SLICE_DIGITS = 3
#: Slope of a source's schedule, by its place in the order of sources: early, even and late.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    Targets are min(most * size, level * weight) with the one level at which they sum to share * all sizes:
    what sharing the excess of capped sources again and again by weight ends at. In order of
    most * size / weight, a source is capped if the level that is left for it and all after it reaches its cap.
    The table has a row per source, so its windows are small.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*map(F.lit, map(float, weights)))
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(in_order) - 1)
        .withColumn("_w", F.get(cycle, F.col("_rank") % len(weights)))
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_room", F.col("_cap") / F.col("_w"))
    )
    capped_before = F.coalesce(F.sum("_cap").over(by_room), F.lit(0.0))
    weight_before = F.coalesce(F.sum("_w").over(by_room), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - capped_before) / (F.sum("_w").over(everything) - weight_before)
    return ranked.withColumn("_level", level).select(
        "source",
        "source_size",
        F.col("_rank").alias("rank"),
        F.least("_cap", F.max("_level").over(everything) * F.col("_w")).alias("target"),
    )


def position_of(share: Column, slope: Column) -> Column:
    """The t with t + slope * (t * t - t) = share: the inverse of the integral of 1 + slope * (2 t - 1)."""
    straight = 1 - slope
    root = (F.sqrt(straight * straight + 4 * slope * share) - straight) / (2 * slope)
    return F.when(slope == 0, share).otherwise(root)


def plan_mixture(
    df: DataFrame,
    size: str = "size",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """All rows and columns of ``df`` with source_size, target, taken, passes and position.

    ``passes`` lists for each pass over the source in which the document is used its words (``words``) and
    training position (``position``); ``taken`` is the sum of the words, ``position`` the first pass's.

    * Sources are ordered by code point, null last, and get the weights in turn. Null is a source.
    * A document of no words, and one beyond the target, takes nothing, and its position is null.
    * Documents of a source lie in the order of a hash of their key; rows that agree in key and size are
      interchangeable, so reruns agree.
    * Columns of ``df`` with one of the new names are replaced. No rows give no rows.
    """
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    base = (
        df.drop("source_size", "target", "taken", "passes", "position")
        .withColumn("__llm_order", order)
        .withColumn("__llm_slice", F.conv(F.substring("__llm_order", 1, SLICE_DIGITS), 16, 10).cast("int"))
        .withColumn("__llm_null", F.col(source).isNull())
        .withColumn("__llm_source", F.coalesce(F.col(source), F.lit("")))
    )
    cells = base.groupBy("__llm_source", "__llm_null", "__llm_slice").agg(F.sum(size).alias("__llm_words"))
    sources = targets(
        cells.groupBy("__llm_source", "__llm_null").agg(F.sum("__llm_words").alias("source_size")).select(F.when(~F.col("__llm_null"), F.col("__llm_source")).alias("source"), "source_size"),
        weights, share, most,
    ).select(F.coalesce("source", F.lit("")).alias("__llm_s2"), F.col("source").isNull().alias("__llm_n2"), "source_size", "target", F.col("rank").alias("__llm_rank"))
    before = Window.partitionBy("__llm_source", "__llm_null").orderBy("__llm_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cells.withColumn("__llm_before", F.coalesce(F.sum("__llm_words").over(before), F.lit(0)))
        .join(sources, (F.col("__llm_source") == F.col("__llm_s2")) & (F.col("__llm_null") == F.col("__llm_n2")))
        .select(F.col("__llm_source").alias("__llm_s1"), F.col("__llm_null").alias("__llm_n1"), F.col("__llm_slice").alias("__llm_slice1"), "__llm_before", "source_size", "target", "__llm_rank")
    )
    local = Window.partitionBy("__llm_source", "__llm_null", "__llm_slice").orderBy("__llm_order", key, size).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn("__llm_here", F.coalesce(F.sum(size).over(local), F.lit(0)))
        .join(carry, (F.col("__llm_source") == F.col("__llm_s1")) & (F.col("__llm_null") == F.col("__llm_n1")) & (F.col("__llm_slice") == F.col("__llm_slice1")))
        .withColumn("__llm_start", F.col("__llm_before") + F.col("__llm_here"))
    )
    slope = F.get(F.array(*map(F.lit, SLOPES)), F.col("__llm_rank") % len(SLOPES))

    def one_pass(e: int) -> Column:
        start = F.col("__llm_start") + e * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col(size), F.floor("target") - start))
        return F.struct(
            F.lit(e).alias("pass"),
            words.alias("words"),
            F.when(words > 0, position_of(start / F.col("target"), slope)).alias("position"),
        )

    used = F.filter(F.array(*[one_pass(e) for e in range(int(-(-most // 1)))]), lambda p: p["words"] > 0)
    return (
        placed.withColumn("passes", used)
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
        .withColumn("position", F.get("passes", F.lit(0))["position"])
        .drop("__llm_order", "__llm_slice", "__llm_null", "__llm_source", "__llm_here", "__llm_s1", "__llm_n1", "__llm_slice1", "__llm_before", "__llm_start", "__llm_rank")
    )


def leading_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, white space between words kept."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, 1, words.cast("int")), "")


def arrange(planned: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """The training order: a row per document and pass, the last pass's part cut, range-sorted by position."""
    rows = planned.withColumn("__llm_p", F.explode("passes")).withColumn("position", F.col("__llm_p.position"))
    whole = F.col("__llm_p.words") == F.col(size)
    return (
        rows.withColumn(text, F.when(whole, F.col(text)).otherwise(leading_words(F.col(text), F.col("__llm_p.words"))))
        .orderBy("position", F.col("__llm_p.pass"))
        .drop("__llm_p", "passes", "taken", "target", "source_size")
    )
