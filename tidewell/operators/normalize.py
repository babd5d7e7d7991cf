"""Records to canonical events, and their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import emoji_matches, url_matches, utf16_len, word_count
from ..shared import materialize


#: Line numbers of a file that are numbered in one task.
LINES = 65_536


def _with_sequence(rows: DataFrame) -> DataFrame:
    """Adds sequence_num, a row's number in its file from 1 by line_no: a range of lines is numbered apart, after the rows of the ranges before it."""
    ranged = rows.withColumn("_range", F.floor(F.col("line_no").cast("double") / LINES))
    sizes = ranged.groupBy("source_file", "_range").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy("source_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("source_file").alias("_file"), F.col("_range").alias("_start"), F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("source_file", "_range").orderBy("line_no")))
    met = own.join(starts, F.col("source_file").eqNullSafe(F.col("_file")) & F.col("_range").eqNullSafe(F.col("_start")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_n")).cast("long").alias("sequence_num"))


def _with_counted_sequence(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``_with_sequence`` without a shuffle of rows: their ``lines`` (source_file, line_no) are counted first, a bit each in a small table that rows then meet.

    Lines that are null, negative or repeated in their file are numbered by ``_with_sequence``.
    """
    at = F.col("line_no").cast("long") + 1
    bucket, position = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    own = lines.groupBy(F.col("source_file").alias("_file"), bucket.alias("_bucket"), (F.col("line_no") >= 0).alias("_usual")).agg(F.bitmap_construct_agg(position).alias("_bits"), F.count(F.lit(1)).alias("_n"), F.max(position).alias("_last"))
    w = Window.partitionBy("_file").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bits = F.expr("substring(_bits, 1, cast(_last div 8 as int) + 1)")
    counted = materialize(own.select("_file", "_bucket", (F.coalesce("_usual", F.lit(False)) & (F.bitmap_count("_bits") == F.col("_n"))).alias("_usual"), bits.alias("_bits"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "lines")
    if not counted.where(~F.col("_usual")).isEmpty():
        return _with_sequence(rows)
    met = rows.withColumns({"_at": bucket, "_p": position}).join(counted, F.col("source_file").eqNullSafe(F.col("_file")) & (F.col("_at") == F.col("_bucket")))
    rank = F.expr("bitmap_count(substring(_bits, 1, cast(_p div 8 as int))) + bit_count(cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int) & (shiftleft(2, cast(_p % 8 as int)) - 1))")
    return met.select(*rows.columns, (F.col("_before") + rank).cast("long").alias("sequence_num"))


def normalize(records: DataFrame, dataset_id: str, default_ts=None, count_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): records with a time and a content as events, the others apart.

    Identifiers are digests of dataset, file and line, so a second run gives the
    same ones. ``default_ts`` stands for times that can't be read. Texts are
    sorted to number events only where they are asked for; ``count_lines`` reads
    the records once more before instead, so that no text is shuffled.
    """
    ts = F.coalesce("ts", F.lit(default_ts).cast("timestamp")) if default_ts is not None else F.col("ts")
    rows = records.withColumn("ts", ts)
    good = F.col("ts").isNotNull() & F.col("content").isNotNull()
    content = F.col("content")
    urls, emojis = F.array_distinct(url_matches(content, loose=True)), F.array_distinct(emoji_matches(content))
    # What texts tell comes before numbers, so that a text nobody asks for isn't carried there.
    told = rows.where(good).select(
        "source_file",
        "line_no",
        "actor",
        "ts",
        "raw_timestamp",
        "content",
        F.coalesce("event_type", F.lit("message")).alias("event_type"),
        utf16_len(content).alias("char_length"),
        word_count(content).alias("word_count"),
        (F.size(urls) > 0).alias("has_urls"),
        (F.size(emojis) > 0).alias("has_emojis"),
        F.coalesce("has_media", F.lit(False)).alias("has_media"),
        urls.alias("urls"),
        emojis.alias("emojis"),
        "metadata",
    )
    numbered = _with_counted_sequence(told, rows.where(good).select("source_file", "line_no")) if count_lines else _with_sequence(told)
    events = numbered.select(
        F.sha2(F.concat_ws("|", F.lit(dataset_id), "source_file", "line_no"), 256).alias("id"),
        F.lit(dataset_id).alias("dataset_id"),
        "source_file",
        F.when(F.trim("actor") != "", F.sha2(F.lower(F.trim("actor")), 256)).alias("entity_id"),
        "actor",
        "ts",
        "raw_timestamp",
        "sequence_num",
        "content",
        "event_type",
        "char_length",
        "word_count",
        "has_urls",
        "has_emojis",
        "has_media",
        "urls",
        "emojis",
        "metadata",
    )
    return events, rows.where(~good)


def resolve_entities(events: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities of all datasets by trimmed lower-case name: entity_id, normalized, name (as first seen), first_ts; known ones keep their name."""
    seen = events.where("trim(actor) <> ''").groupBy(F.lower(F.trim("actor")).alias("normalized")).agg(F.min(F.struct("ts", "id", F.trim("actor").alias("name"))).alias("f"))
    rows = seen.select(F.sha2("normalized", 256).alias("entity_id"), "normalized", F.col("f.name").alias("name"), F.col("f.ts").alias("first_ts"))
    if entities is None:
        return rows
    return entities.select(rows.columns).unionByName(rows.join(entities, "entity_id", "left_anti"))
