"""Fill-in-the-middle transformation by one match of a counted pattern, on DataFrame functions alone.

A text is a row of units (lines, or what another pattern says). ``regexp_count`` gives their number n, two hashed
draws from 0..n give the borders a <= b, and a pattern made for the row takes a units, then b - a units, then the rest:
three groups of one match, which the same replacement puts into their new order. The counted groups are
possessive: the units before a border can be read in one way only, so nothing is tried again and the match is
linear in the text, whatever the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or a last line without one. The inner quantifiers give nothing back, as a line ends in one place.
LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ORDERS = {"psm": (PREFIX, "$1", SUFFIX, "$3", MIDDLE, "$2"), "spm": (SUFFIX, "$3", PREFIX, "$1", MIDDLE, "$2")}
_BACK = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws: the leading groups of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = LINE,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
) -> DataFrame:
    """All rows and columns of ``df``, with n, form, prefix_chars, middle_chars and output.

    * n is the number of units of the text, matched left to right. The prefix ends after the smaller of two draws from
      0..n, the middle after the larger; either of the three parts may be empty.
    * ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of those with the suffix first (``spm``), the others with
      the prefix first (``psm``). An empty text, and one that holds a mark, stays as it is (``plain``): its lengths are
      null and its output is the text. Null is an empty text.
    * ``unit`` must match every character of a text in one way only (a text is cut into units without rests); lengths are code points.
    * The draws depend on ``seed`` and key alone (a null key counts as an empty one), so repeated rows get the same result
      and a rerun repeats it. Columns of ``df`` with one of the new names are replaced. No rows give no rows.
    """
    h1, h2, h3, h4 = _draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.drop("n", "form", "prefix_chars", "middle_chars", "output").withColumn("__llm_n", F.regexp_count(whole, F.lit(unit)).cast("long"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | whole.contains(mark)
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cuts = base.select("*", form.alias("__llm_form"), (h1 % (F.col("__llm_n") + 1)).alias("__llm_x"), (h2 % (F.col("__llm_n") + 1)).alias("__llm_y"))
    low, high = F.least("__llm_x", "__llm_y"), F.greatest("__llm_x", "__llm_y")
    pattern = F.format_string(r"(?s)\A((?:%1$s){%2$d}+)((?:%1$s){%3$d}+)(.*)\z", F.lit(unit), low, high - low)
    order = F.when(F.col("__llm_form") == "spm", "".join(_ORDERS["spm"])).otherwise("".join(_ORDERS["psm"]))
    made = F.when(F.col("__llm_form") == "plain", whole).otherwise(F.regexp_replace(whole, pattern, order))
    out = cuts.withColumn("__llm_output", made)

    def place(mark: str) -> Column:
        return F.instr("__llm_output", mark)

    # The text holds no mark, so each mark stands once in the output: lengths are the distances between them.
    before = F.when(F.col("__llm_form") == "psm", place(SUFFIX)).otherwise(place(MIDDLE)) - place(PREFIX) - len(PREFIX)
    middle = F.char_length("__llm_output") - place(MIDDLE) - len(MIDDLE) + 1
    moved = F.col("__llm_form") != "plain"
    named = {"n": F.col("__llm_n"), "form": F.col("__llm_form"), "prefix_chars": F.when(moved, before).cast("long"), "middle_chars": F.when(moved, middle).cast("long"), "output": F.col("__llm_output")}
    kept = [F.col(c) for c in df.columns if c not in named]
    return out.select(*kept, *[c.alias(name) for name, c in named.items()])


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output of ``transform`` was made of, from the output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    back = output
    for name, (pattern, order) in _BACK.items():
        back = F.when(form == name, F.regexp_replace(output, pattern, order)).otherwise(back)
    return back
