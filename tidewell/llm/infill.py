"""Fill-in-middle texts: lines of a document cut into prefix, middle and suffix by one counted match.

``regexp_count`` gives a text's number of units, two digests of its identifier
give two cuts, and a pattern made for the row, with possessive counted groups
for the units before the first cut and between the cuts, matches the whole text
once; its replacement is the output. All of it is native and row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_names

#: A unit: a line with its line feed, or what comes after the last one.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
#: The columns that fill_in_middle adds.
ADDED = ["n_units", "form", "output"]


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINE) -> DataFrame:
    """Adds n_units, form (plain, psm or spm) and output to each document.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of these have the suffix
    first. Texts without a unit, and texts that hold a mark, stay plain, so
    output and form always give the text back (``restored``). The units of
    ``unit`` must lie side by side over the whole text.

    A null text is an empty one and a null identifier an empty word. Equal
    identifiers are cut alike, whatever their texts; repeated rows stay. No rows
    give none. The caller's columns stay, and one that is named as an added
    column gets ``_given``.
    """
    one, two, drawn, order = _draws("_id", seed)
    own = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, given_names(docs.columns, [*ADDED, "_id", "_text", "_first", "_last"]))], F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    counted = own.withColumn("n_units", F.regexp_count("_text", F.lit(unit)).cast("long"))
    cuts = one % (F.col("n_units") + 1), two % (F.col("n_units") + 1)
    plain = (F.length("_text") == 0) | F.col("_text").rlike(MARKS) | (drawn % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(order % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    placed = counted.withColumns({"_first": F.least(*cuts), "_last": F.greatest(*cuts), "form": form})
    group = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    # Possessive: each group takes its units once, without a stack frame or a way back for each of them.
    pattern = F.concat(F.lit(r"\A"), group(F.col("_first")), group(F.col("_last") - F.col("_first")), F.lit(r"((?s:.*))\z"))
    layout = F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")).otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    made = placed.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, layout)))
    return made.drop("_id", "_text", "_first", "_last")


def parts(output: Column, form: Column) -> Column:
    """Prefix, middle and suffix of an output, as an array; null for a plain one."""
    cut = F.split(output, MARKS)
    psm = F.array(F.get(cut, 1), F.get(cut, 3), F.get(cut, 2))
    spm = F.array(F.get(cut, 2), F.get(cut, 3), F.get(cut, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    return F.when(form == "plain", output).otherwise(F.array_join(parts(output, form), ""))
