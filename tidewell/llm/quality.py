"""Quality rules whose thresholds come from the corpus.

Each text gets a few integer measures. For each language and source, a
mergeable quantile sketch of each measure gives its quartiles; a text is
rejected where a measure lies far outside of them. Fixed rules come first.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_names, in_arrow, materialize

SYMBOLS = re.compile("[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measures and the side on which a value is suspect: -1 low, 1 high.
MEASURES = {"_tw_m_words": -1, "_tw_m_word_len": 1, "_tw_m_symbols": 1, "_tw_m_dup_lines": 1, "_tw_m_repeats": 1}
#: Rows of a group below which the language's thresholds hold, and below which all rows' hold.
LEAST_ROWS = 100
#: Distance from a quartile, in quartile ranges, beyond which a value is rejected.
FENCE = 3
#: A range is never less than what so many symbols, lines or words make of a text of the group's median length, nor a 16th of the word length.
EVENTS = {"_tw_m_symbols": 10, "_tw_m_dup_lines": 2, "_tw_m_repeats": 20}
_W, _L = "greatest(_tw_m_words_q2, 1)", "greatest(_tw_m_words_q2 * _tw_m_word_len_q2 div 1000, 1)"


def _high(m: str, least: str) -> str:
    return f"{m}_q3 + {FENCE} * greatest({m}_q3 - {m}_q1, {least})"


#: SQL of each measure's limit, by its group's quartiles. Lengths vary by factors, so a text is too short if it
#: falls as far below the lower quartile as the square of the factor (1.1 at least) between that and the median.
LIMITS = {
    "_tw_m_words": f"case when 10 * _tw_m_words_q2 < 11 * _tw_m_words_q1 then _tw_m_words_q1 * 100 div 121 else _tw_m_words_q1 * _tw_m_words_q1 div {_W} * _tw_m_words_q1 div {_W} end",
    "_tw_m_word_len": _high("_tw_m_word_len", "_tw_m_word_len_q3 div 16"),
    "_tw_m_symbols": _high("_tw_m_symbols", f"{EVENTS['_tw_m_symbols']} * 1000 div {_L}"),
    "_tw_m_dup_lines": _high("_tw_m_dup_lines", f"{EVENTS['_tw_m_dup_lines']} * 1000 div {_W}"),
    "_tw_m_repeats": _high("_tw_m_repeats", f"{EVENTS['_tw_m_repeats']} * 1000 div {_W}"),
}
#: Leading bits of a value that a sketch keeps: its error is below 1 / 2**(BITS - 1) of the value.
BITS = 6


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; a null has no words.

    Words lie between ASCII white space. A line is a duplicate if it has a word
    and equals an earlier line. A word repeats if it is in a window of three
    words that the text has twice or more.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(b"".join(words).decode())
    lines = [line for line in text.split("\n") if line.encode().split()]
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            hit = np.zeros(len(words) + 2, bool)
            at = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            n = len(windows)
            for k in range(3):
                hit[k : n + k] |= at
            repeats = int(hit.sum())
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with _tw_ and the name of each count."""
    kept = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in kept] + [T.StructField(f"_tw_{c}", T.LongType()) for c in COUNTS]

    def count(batches):
        for batch in batches:
            rows = np.array([text_counts(t) for t in batch.column(0).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            cols = [batch.column(i + 1) for i in range(len(kept))] + [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    at = docs.select(F.col(f"`{text_col}`").cast("string").alias("_tw_text"), *[F.col(f"`{c}`") for c in kept])
    return in_arrow(at, count, T.StructType(fields))


def measured(counted: DataFrame) -> DataFrame:
    """Adds the measures: words, and thousandths of words, characters or lines."""
    per_1000 = lambda c: F.expr(f"_tw_{c} * 1000 div greatest(_tw_n_words, 1)")
    return counted.withColumns(
        {
            "_tw_m_words": F.col("_tw_n_words"),
            "_tw_m_word_len": per_1000("word_chars"),
            "_tw_m_symbols": F.expr("_tw_n_symbols * 1000 div greatest(_tw_word_chars, 1)"),
            "_tw_m_dup_lines": per_1000("n_dup_lines"),
            "_tw_m_repeats": per_1000("n_repeat_words"),
        }
    )


def bucket(value: str) -> str:
    """SQL of the sketch's bucket of a non-negative whole number: its length in bits and its leading bits."""
    return f"(length(bin({value})) * {1 << BITS} + ({value} >> greatest(length(bin({value})) - {BITS}, 0)))"


def bucket_floor(at: str) -> str:
    """SQL of the least value of a bucket."""
    return f"(({at} % {1 << BITS}) << greatest({at} div {1 << BITS} - {BITS}, 0))"


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Quantile sketches of the measures: measure, groups, bucket, n.

    Buckets are as in an HDR histogram: they depend on a value alone, so
    sketches merge by adding counts, in any order, to the same result. A group
    has at most 64 times 58 buckets a measure, whatever its size, and map-side
    aggregation merges a hot group before any shuffle.
    """
    long = rows.selectExpr(*groups, "inline(array(" + ", ".join(f"named_struct('measure', '{m}', 'value', {m})" for m in MEASURES) + "))")
    return long.groupBy(*groups, "measure", F.expr(bucket("value")).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The quartiles of each group and measure, and its rows."""
    part = ", ".join([*groups, "measure"])
    ranked = sketch.selectExpr("*", f"sum(n) over (partition by {part} order by bucket) as upto", f"sum(n) over (partition by {part}) as total")
    return ranked.groupBy(*groups, "measure").agg(
        *[F.min(F.expr(f"case when upto * 4 >= total * {k} then {bucket_floor('bucket')} end")).alias(f"q{k}") for k in (1, 2, 3)],
        F.max("total").alias("rows"),
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each language and source that occurs: _tw_lang, _tw_source and a limit for each measure.

    A group of fewer than LEAST_ROWS rows takes its language's quartiles; a
    language of fewer takes those of all rows. The sketches of languages and of
    all rows are sums of the groups' sketches.
    """
    groups = ["_tw_lang", "_tw_source"]
    sketch = sketches(rows, groups)
    by_lang = sketch.groupBy("_tw_lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    by_all = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    own = quartiles(sketch, groups)
    renamed = lambda q, by, x: q.select(*[F.col(c).alias(f"_{x}") for c in by], F.col("measure").alias(f"_m{x}"), *[F.col(f"q{k}").alias(f"{x}{k}") for k in (1, 2, 3)], F.col("rows").alias(f"{x}_rows"))
    lang, all_ = renamed(quartiles(by_lang, ["_tw_lang"]), ["_tw_lang"], "l"), renamed(quartiles(by_all, []), [], "a")
    met = own.join(lang, F.col("_tw_lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_ml"))).join(all_, F.col("measure") == F.col("_ma"))
    pick = lambda k: F.expr(f"case when rows >= {LEAST_ROWS} then q{k} when l_rows >= {LEAST_ROWS} then l{k} else a{k} end")
    wide = met.groupBy(*groups).agg(*[F.max(F.when(F.col("measure") == m, pick(k))).alias(f"{m}_q{k}") for m in MEASURES for k in (1, 2, 3)])
    return wide.select(*groups, *[F.expr(limit).cast("long").alias(f"{m}_limit") for m, limit in LIMITS.items()])


FIXED_RULES = "_tw_n_words < 50 or 100 * _tw_n_repeat_words > 50 * _tw_n_words"
OUTSIDE = " or ".join(f"{m} {'<' if s < 0 else '>'} {m}_limit" for m, s in MEASURES.items())


ADDED = [*(f"_tw_{c}" for c in COUNTS), "_tw_base_failed", "_tw_kept"]


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to ``docs`` (or its ``keep`` columns), each with _tw_ before its name.

    Texts are read and counted twice and never shuffled, unless the limits
    outgrow a broadcast: the first pass sketches all rows that the fixed rules
    leave, the second joins each row with the limits of its language and source.

    A null text has no words, so the fixed rules reject it; a null language or
    source is a value of its own; repeated rows count each. No rows give none.
    A caller's column of the same name as an added one gets ``_given`` at its end.
    """
    kept = docs.columns if keep is None else keep
    own = [f"k{i}" for i in range(len(kept))]
    groups = [F.col(f"`{c}`").cast("string").alias(k) for c, k in ((lang_col, "_tw_lang"), (source_col, "_tw_source"))]
    base = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, own)], *groups)
    slim = measured(with_counts(base, "text", ["_tw_lang", "_tw_source"])).where(f"not ({FIXED_RULES})")
    # Written first, so that the join below knows their size before it shuffles any text.
    limits = materialize(thresholds(slim), "limits").select(F.col("_tw_lang").alias("_l"), F.col("_tw_source").alias("_s"), *[f"{m}_limit" for m in MEASURES])
    rows = measured(with_counts(base, "text", [*own, "_tw_lang", "_tw_source"]))
    met = rows.join(limits, F.col("_tw_lang").eqNullSafe(F.col("_l")) & F.col("_tw_source").eqNullSafe(F.col("_s")), "left")
    return met.select(
        *[F.col(k).alias(name) for k, name in zip(own, given_names(kept, ADDED))],
        *[F.col(f"_tw_{c}") for c in COUNTS],
        F.expr(FIXED_RULES).alias("_tw_base_failed"),
        F.expr(f"not ({FIXED_RULES}) and not coalesce({OUTSIDE}, false)").alias("_tw_kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the fixed rules and the limits of their language and source keep, with their own columns."""
    rows = quality(docs, text_col, lang_col, source_col)
    names = [f"k{i}" for i in range(len(docs.columns))]
    good = rows.toDF(*names, *ADDED).where("_tw_kept")
    return good.select(*[F.col(k).alias(c) for k, c in zip(names, docs.columns)])
