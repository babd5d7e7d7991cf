"""Lines and JSON items of files of any size, read in byte ranges.

Spark's text reader cuts files into ranges and finds each range's first record by
its separator. What a range needs from those before it (how many lines there
were, whether a string is open, how deep brackets are) is a few numbers, so it
comes from a small table of ranges by prefix sums. No row holds a file, and a
file's ranges are read by as many tasks.

Pieces are rows (source_file, part, seq, value): a file's text in order of part
and seq. A part is read by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Rows of a file that are numbered by one task, where there are no ranges to go by.
STRETCH = 100_000


def _in_part():
    return Window.partitionBy("source_file", "part").orderBy("seq")


def _before():
    return _in_part().rowsBetween(Window.unboundedPreceding, -1)


def ranges(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """Rows (source_file, part, seq, value, file_size) of text files cut at line ends, or at ``sep``; a part is the first byte of a range."""
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    meta = lambda c: F.col(f"_metadata.{c}")
    return reader.text(path).select(meta("file_path").alias("source_file"), meta("file_block_start").alias("part"), F.monotonically_increasing_id().alias("seq"), "value", meta("file_size").alias("file_size"))


def with_before(rows: DataFrame, **counted: Column) -> DataFrame:
    """Adds, by name, the sums of columns over all that comes before a row in its file."""
    parts = rows.groupBy("source_file", "part").agg(*[F.sum(c).alias(n) for n, c in counted.items()])
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("source_file").alias("_f"), F.col("part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in counted])
    met = rows.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(_before()), F.lit(0)) for n, c in counted.items()}).join(carry, (F.col("source_file") == F.col("_f")) & (F.col("part") == F.col("_p")))
    return met.select(*rows.columns, *[(F.col(f"_carry_{n}") + F.col(f"_own_{n}")).alias(n) for n in counted])


# ---------------------------------------------------------------- lines


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files: source_file, part, line_no (from 0), line.

    A range's lines are counted where they are read: seq goes up by one from
    line to line, so a line needs its range's first seq and the lines of earlier
    ranges, a row a range, and no text is shuffled.
    """
    rows = ranges(spark, path).drop("file_size")
    parts = rows.groupBy("source_file", "part").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("source_file").alias("_f"), F.col("part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = rows.join(F.broadcast(carry), (F.col("source_file") == F.col("_f")) & (F.col("part") == F.col("_p")))
    return met.select("source_file", "part", (F.col("_before") + F.col("seq") - F.col("_first")).alias("line_no"), F.col("value").alias("line"))


def lines_of_pieces(pieces: DataFrame) -> DataFrame:
    """Lines of texts in pieces that are cut anywhere; a line that spans pieces is put together again."""
    cut = pieces.withColumn("_lines", F.split("value", "\n"))
    at = with_before(cut, first=F.size("_lines") - 1).select("source_file", "part", "seq", "first", F.posexplode("_lines").alias("k", "line"))
    line = at.groupBy("source_file", (F.col("first") + F.col("k")).alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("part", "seq", "k", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "")
    lines = line.select("source_file", "line_no", F.explode(F.split(F.regexp_replace(text, r"\r\z", ""), "\r")).alias("line"))
    return lines.select("source_file", F.floor(F.col("line_no") / STRETCH).alias("part"), "line_no", "line")


# ---------------------------------------------------------------- JSON


def json_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files as pieces that end with the next closing brace."""
    rows = ranges(spark, path, "}")
    facts = rows.groupBy("source_file").agg(F.max(F.struct("part", "seq")).alias("last"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("size"))
    # The reader drops separators (and a byte order mark), so only the bytes tell whether a file's last one was there.
    last = materialize(facts.select(F.col("source_file").alias("_f"), F.col("last.part").alias("_p"), (F.col("bytes") - F.col("size")).isin(1, -2).alias("_open")), "json-ends")
    met = rows.join(last, F.col("source_file") == F.col("_f")).withColumn("_end", F.lead("seq").over(_in_part()).isNull() & (F.col("part") == F.col("_p")) & F.col("_open"))
    return met.select("source_file", "part", "seq", F.when(F.col("_end"), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value"))


def braced(pieces: DataFrame) -> DataFrame:
    """Pieces cut anew after each closing brace."""
    return pieces.select("source_file", "part", F.posexplode(F.split("value", r"(?<=\})")).alias("seq", "value")).select("source_file", "part", F.col("seq").cast("long").alias("seq"), "value")


def _quotes(text: Column) -> Column:
    """How many quotes of a piece aren't escaped."""
    return F.length(F.regexp_replace(text, r'(?s)\\.?|[^"\\]+', ""))


def _deeper(text: Column) -> Column:
    """How much deeper brackets are after a text that begins outside of strings."""
    plain = F.regexp_replace(text, r'(?s)"(?:[^"\\]++|\\.)*+"?', "")
    opened, closed = (F.length(F.regexp_replace(plain, rf"[^{c}]+", "")) for c in (r"\[{", r"\]}"))
    return opened - closed


def _placed(pieces: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """Adds item (the number of items that end before a piece), base (the depth of items) and broken (the file's brackets don't match)."""
    rows = pieces.withColumns({"q": _quotes(F.col("value")), "d0": _deeper(F.col("value")), "d1": _deeper(F.concat(F.lit('"'), "value"))})
    inside = F.coalesce(F.sum("q").over(_before()), F.lit(0)) % 2
    rel = rows.withColumn("in", inside)
    # Both answers for each part: as if it began outside of a string, and inside of one.
    parts = rel.groupBy("source_file", "part").agg(
        F.sum("q").alias("q"), F.sum(F.when(F.col("in") == 0, F.col("d0")).otherwise(F.col("d1"))).alias("d0"), F.sum(F.when(F.col("in") == 0, F.col("d1")).otherwise(F.col("d0"))).alias("d1"),
        F.min_by(F.substring(F.regexp_replace("value", r"\A[\s\uFEFF]+", ""), 1, 1), "seq").alias("head"),
    )
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file")
    started = parts.withColumn("p_in", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).withColumn("d", F.when(F.col("p_in") == 0, F.col("d0")).otherwise(F.col("d1")))
    root = F.first(F.nullif("head", F.lit("")), ignorenulls=True).over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = F.when(root == "[", 1).when((root == "{") & F.lit(bool(containers)), 2).otherwise(0)
    facts = started.select(F.col("source_file").alias("_f"), F.col("part").alias("_p"), "p_in", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("p_depth"), base.alias("base"), ((F.sum("q").over(whole) % 2 == 1) | (F.sum("d").over(whole) != 0)).alias("broken"))
    met = rel.join(materialize(facts, "json-parts"), (F.col("source_file") == F.col("_f")) & (F.col("part") == F.col("_p")))
    own = met.withColumn("in", (F.col("in") + F.col("p_in")) % 2).withColumn("d", F.when(F.col("in") == 0, F.col("d0")).otherwise(F.col("d1")))
    depth = F.col("p_depth") + F.sum("d").over(_in_part())
    ends = F.col("value").endswith("}") & ((F.col("in") + F.col("q")) % 2 == 0) & (depth == F.col("base"))
    return with_before(own.select("source_file", "part", "seq", "value", "base", "broken", ends.cast("int").alias("ends")), item=F.col("ends"))


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{}:,]|[^\s\[\]{}:,"\ufeff]+', re.S)


def cut_items(text: str, base: int, first: bool) -> tuple[list[tuple[str | None, str | None]], bool]:
    """The pieces (context, item) of a stretch that ends with an item or the file, and whether its commas and brackets are wrong.

    A context without an item tells that brackets at the items' depth open (a
    and the key for an array, o for an object) or close (-). Other items have
    the last context of this stretch, or None for that of the ones before it.
    """
    out: list[tuple[str | None, str | None]] = []
    depth, after, bad = (0, False, False) if first else (base, True, False)
    context = key = start = end = None

    def flush() -> None:
        nonlocal start
        if start is not None:
            out.append((context, text[start:end]))
            start = None

    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in "[{":
            if depth == base:
                bad |= after
                start, end = m.start() if start is None else start, m.end()
            elif depth == base - 1:
                context, after = ("a" if t == "[" else "o") + (key or ""), False
                out.append((context, None))
            depth += 1
        elif t in "]}":
            depth -= 1
            if depth == base - 1:
                flush()
                context, after, key = "-", False, None
                out.append((context, None))
            elif depth == base:
                end = m.end()
            bad |= depth < 0
        elif depth == base and t == "," and base:
            bad |= start is None and not after
            flush()
            after = False
        elif depth == base:
            bad |= after
            start, end = m.start() if start is None else start, m.end()
        elif depth == 0:
            bad = True
        elif depth < base and t[0] == '"':
            try:
                key = json.loads(t, strict=False)
            except ValueError:
                bad = True
    flush()
    return out, bad


def json_items(pieces: DataFrame, containers: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of JSON texts in pieces: (source_file, line_no, item), broken texts' (source_file), and fields (source_file, key, field) of objects below the root.

    Items are those of a root array, or of the first of ``containers`` that is
    an array below the root, or the root alone. A text is broken if brackets,
    quotes or the commas between items are wrong; an item isn't looked into.
    """
    rows = _placed(pieces, containers)
    stretch = rows.groupBy("source_file", "item").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "value"))).alias("p"), F.first("base").alias("base"), F.first("broken").alias("broken"))
    text = stretch.select("source_file", F.col("item").cast("long").alias("at"), "base", "broken", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("text"))
    plain = F.regexp_replace("text", r"\A\s*,\s*", "")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, at, base, broken, value, plain in zip(f["source_file"], f["at"], f["base"], f["broken"], f["text"], f["plain"]):
                if plain is not None:
                    out.append((file, at, 0, base, broken, None, plain))
                    continue
                found, bad = cut_items(value, base, at == 0)
                out += [(file, at, k, base, broken or bad, c, i) for k, (c, i) in enumerate(found or [(None, None)])]
            for lo in range(0, len(out), 5_000):
                yield pd.DataFrame(out[lo : lo + 5_000], columns=["source_file", "at", "k", "base", "broken", "context", "item"])

    simple = text.withColumn("plain", F.when((F.col("at") > 0) & F.col("text").rlike(r"\A\s*,\s*\{") & F.col("text").endswith("}"), plain)).withColumn("text", F.when(F.col("plain").isNull(), F.col("text")))
    made = materialize(simple.mapInPandas(cut, "source_file string, at long, k int, base int, broken boolean, context string, item string"), "json-items")
    broken = made.groupBy("source_file").agg(F.max("broken").alias("broken"), F.max("base").alias("base"))
    # Where brackets open and close below the root: a few rows a file.
    turn = made.where("item is null and context is not null").select("source_file", "at", "k", "base", "context")
    ended = turn.withColumn("until", F.lead(F.struct("at", "k")).over(Window.partitionBy("source_file").orderBy("at", "k")))
    rank = F.coalesce(F.array_position(F.array(*[F.lit("a" + c) for c in containers]), F.col("context")), F.lit(0)) if containers else F.lit(0)
    wanted = ended.withColumn("rank", rank).where((F.col("rank") > 0) | (F.col("base") == 1) & F.col("context").startswith("a"))
    chosen = wanted.groupBy("source_file").agg(F.min_by(F.struct(F.struct("at", "k").alias("since"), "until"), F.struct("rank", -F.col("at"), -F.col("k"))).alias("r"))
    state = materialize(broken.join(chosen, "source_file", "left").select(F.col("source_file").alias("_f"), "broken", F.col("base").alias("_base"), "r"), "json-files")
    here = F.struct("at", "k")
    good = made.join(state.where("not broken and (_base < 2 or r is not null)").drop("broken"), F.col("source_file") == F.col("_f"))
    items = good.where(F.col("item").isNotNull() & ((F.col("_base") == 0) | (here > F.col("r.since")) & (F.col("r.until").isNull() | (here < F.col("r.until")))))
    parted = items.select("source_file", F.floor(F.col("at") / STRETCH).alias("part"), F.struct("at", "k").alias("seq"), "item")
    numbered = with_before(parted, line_no=F.lit(1)).select("source_file", "line_no", "item")
    # A root object without a container is one item, of all its pieces.
    alone = pieces.join(state.where("not broken and _base = 2 and r is null").select("_f"), F.col("source_file") == F.col("_f"), "left_semi").groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "value"))).alias("p"))
    one = alone.select("source_file", F.lit(0).cast("long").alias("line_no"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("item"))
    fields = made.where("context like 'o%' and item is not null").select("source_file", F.substring("context", 2, 1 << 30).alias("key"), F.col("item").alias("field"))
    return numbered.unionByName(one), state.where("broken").select(F.col("_f").alias("source_file")), fields
