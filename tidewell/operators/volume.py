"""Volume, activity and people reports. Every report is grouped by dataset_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MILESTONES, WEEKDAYS
from ..functions.text import dow0, ellipsize, utf16_len, word_count
from ..shared import materialize
from .sequence import argmax, order_statistic, top_k_per, with_number, with_previous

DAY = 86_400.0


def measured(ev: DataFrame) -> DataFrame:
    """Adds chars and words: the stored lengths, or else the content's; no event has fewer words than one."""
    stored = lambda c: F.nullif(F.col(c), F.lit(0)) if c in ev.columns else F.lit(None).cast("int")
    chars = F.coalesce(stored("char_length"), utf16_len(F.col("content")))
    words = F.coalesce(stored("word_count"), F.greatest(word_count(F.col("content")), F.lit(1)))
    return ev.withColumns({"chars": chars.cast("long"), "words": words.cast("long")})


def named(actor: str = "actor") -> Column:
    return F.coalesce(F.trim(F.nullif(F.col(actor), F.lit(""))), F.lit("Unknown"))


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def _share(n: str, total: Column) -> Column:
    return F.round(100.0 * F.col(n) / total, 1)


def volume_summary(ev: DataFrame) -> DataFrame:
    e = measured(ev).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return e.select(
        "dataset_id", "messages", "words", "chars",
        F.round(F.col("chars") / F.col("messages")).cast("long").alias("avg_chars"),
        F.round(F.col("words") / F.col("messages")).cast("long").alias("avg_words"),
        "first_ts", "last_ts",
        F.greatest(F.lit(1), F.round(seconds(F.col("first_ts"), F.col("last_ts")) / DAY).cast("long")).alias("span_days"),
    )


def by_person(ev: DataFrame) -> DataFrame:
    e = measured(ev).groupBy("dataset_id", named().alias("actor")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    total = F.sum("messages").over(Window.partitionBy("dataset_id"))
    return e.withColumns({"percentage": _share("messages", total), "avg_chars": F.round(F.col("chars") / F.col("messages")).cast("long"), "avg_words": F.round(F.col("words") / F.col("messages")).cast("long")})


def _filled(ev: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    counts = ev.groupBy("dataset_id", key.alias(name)).agg(F.count(F.lit(1)).alias("messages"))
    slots = ev.select("dataset_id").distinct().withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = slots.join(counts, ["dataset_id", name], "left").withColumn("messages", F.coalesce("messages", F.lit(0)).cast("long"))
    return met.withColumn("percentage", _share("messages", F.sum("messages").over(Window.partitionBy("dataset_id"))))


def by_hour(ev: DataFrame) -> DataFrame:
    """24 rows a dataset."""
    return _filled(ev, F.hour("ts"), "hour", 24)


def by_weekday(ev: DataFrame) -> DataFrame:
    """Seven rows a dataset from 0, a Sunday."""
    return _filled(ev, dow0(F.col("ts")), "dow", 7).withColumn("day_name", F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("dow") + 1))


def by_date(ev: DataFrame) -> DataFrame:
    return ev.groupBy("dataset_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("messages"))


def timeline(ev: DataFrame, interval: str = "day") -> DataFrame:
    """Events by hour, day, week (from Monday), month or year; another interval means day."""
    unit = interval if interval in ("hour", "day", "week", "month", "year") else "day"
    return ev.groupBy("dataset_id", F.date_trunc(unit, "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("messages"))


def peak_bucket(ev: DataFrame, interval: str = "month") -> DataFrame:
    return argmax(timeline(ev, interval), ["dataset_id"], "bucket", "messages", "bucket")


def activity_matrix(ev: DataFrame) -> DataFrame:
    """Events by weekday (0, a Sunday) and hour, without empty cells."""
    return ev.groupBy("dataset_id", dow0(F.col("ts")).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("messages"))


def activity_pivot(ev: DataFrame) -> DataFrame:
    """The same with a column for each hour."""
    rows = ev.withColumn("_h", F.hour("ts")).groupBy("dataset_id", dow0(F.col("ts")).alias("dow")).pivot("_h", list(range(24)))
    wide = rows.agg(F.count(F.lit(1)))
    return wide.select("dataset_id", "dow", *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).cast("long").alias(f"h{h:02d}") for h in range(24)])


def peaks(ev: DataFrame) -> DataFrame:
    """Busiest date, hour and weekday; ties go to the earliest."""
    d = argmax(by_date(ev), ["dataset_id"], "date", "messages", "peak_date").withColumnRenamed("messages", "date_messages")
    h = argmax(by_hour(ev), ["dataset_id"], "hour", "messages", "peak_hour").withColumnRenamed("messages", "hour_messages")
    w = argmax(by_weekday(ev), ["dataset_id"], "dow", "messages", "peak_dow").withColumnRenamed("messages", "dow_messages")
    return d.join(h, "dataset_id").join(w, "dataset_id").withColumn("hour_label", F.format_string("%02d:00 - %02d:00", "peak_hour", (F.col("peak_hour") + 1) % 24))


def activity_summary(ev: DataFrame) -> DataFrame:
    d = by_date(ev).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("active_days"), F.sum("messages").alias("messages"))
    return d.withColumn("avg_per_active_day", F.round(F.col("messages") / F.col("active_days")).cast("long"))


def longest_streak(ev: DataFrame) -> DataFrame:
    """The longest run of active days; ties go to the earliest."""
    w = Window.partitionBy("dataset_id").orderBy("date")
    runs = by_date(ev).withColumn("island", F.date_sub("date", F.row_number().over(w))).groupBy("dataset_id", "island").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return top_k_per(runs, ["dataset_id"], 1, [F.desc("days"), F.asc("start_date")]).select("dataset_id", "days", "start_date", "end_date")


def longest_gap(ev: DataFrame) -> DataFrame:
    """The longest time between active days that don't follow each other, in days; no row for a dataset without one."""
    w = Window.partitionBy("dataset_id").orderBy("date")
    gaps = by_date(ev).withColumn("start_date", F.lag("date").over(w)).withColumn("days", F.datediff("date", "start_date")).where("days > 1").withColumnRenamed("date", "end_date")
    return top_k_per(gaps, ["dataset_id"], 1, [F.desc("days"), F.asc("start_date")]).select("dataset_id", F.col("days").cast("long").alias("days"), "start_date", "end_date")


def response_samples(ev: DataFrame, max_gap: int = 43_200) -> DataFrame:
    """Seconds that an actor took to answer the actor before: dataset_id, actor, secs."""
    lagged = with_previous(ev.where("actor is not null").select("id", "dataset_id", "actor", "ts"), ["actor", "ts"])
    secs = seconds(F.col("prev_ts"), F.col("ts"))
    return lagged.where(F.col("actor") != F.col("prev_actor")).withColumn("secs", secs).where((F.col("secs") > 0) & (F.col("secs") < max_gap)).select("dataset_id", "actor", "secs")


def response_times(ev: DataFrame, max_gap: int = 43_200) -> DataFrame:
    """Mean and upper median of an actor's response seconds, rounded, and the number of samples. No window holds an actor's samples."""
    key = ["dataset_id", "actor"]
    samples = materialize(response_samples(ev, max_gap).withColumn("us", F.round(F.col("secs") * 1_000_000).cast("long")), "responses")
    median = order_statistic(samples, key, "us", F.floor(F.col("n") / 2) + 1, (max_gap * 1_000_000).bit_length())
    mean = samples.groupBy(*key).agg(F.round(F.avg("secs")).cast("long").alias("avg_secs"), F.count(F.lit(1)).alias("samples"))
    return mean.join(median, key).select(*key, "avg_secs", F.round(F.col("us") / 1_000_000).cast("long").alias("median_secs"), "samples")


def fastest_responder(ev: DataFrame, by: str = "avg", min_samples: int = 1) -> DataFrame:
    """The actor with the least ``avg`` or ``median`` seconds; ties go to the first name."""
    rows = response_times(ev).where(F.col("samples") >= min_samples)
    return top_k_per(rows, ["dataset_id"], 1, [F.asc(f"{by}_secs"), F.asc("actor")]).select("dataset_id", "actor", "avg_secs", "median_secs", "samples")


def people_stats(ev: DataFrame) -> DataFrame:
    """An actor's counts, times, hours (24 bins), weekdays (7 bins) and response times; events without actor are left out."""
    e = measured(ev.where("actor is not null"))
    bins = lambda key, n: F.array(*[F.count_if(key == i) for i in range(n)])
    stats = e.groupBy("dataset_id", "actor").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("chars").alias("chars"), F.round(F.avg("chars")).cast("long").alias("avg_chars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        bins(F.hour("ts"), 24).alias("hourly"), bins(dow0(F.col("ts")), 7).alias("daily"),
    )
    return stats.join(response_times(ev), ["dataset_id", "actor"], "left")


def compare_people(ev: DataFrame, a: str, b: str) -> DataFrame:
    return people_stats(ev.where(F.col("actor").isin(a, b))).drop("avg_secs", "median_secs", "samples").join(response_times(ev), ["dataset_id", "actor"], "left")


def first_last(ev: DataFrame) -> DataFrame:
    at = F.struct("ts", "id")
    return ev.groupBy("dataset_id").agg(F.min(at).alias("a"), F.max(at).alias("z")).selectExpr("dataset_id", "a.id as first_id", "a.ts as first_ts", "z.id as last_id", "z.ts as last_ts")


def milestones(ev: DataFrame, ns: list[int] | None = None) -> DataFrame:
    """The n-th events of each dataset, for the given numbers."""
    return with_number(ev).where(F.col("n").isin(list(ns or MILESTONES))).select("dataset_id", "n", "id", "actor", "ts")


def longest_messages(ev: DataFrame, k: int = 5, max_chars: int | None = 500, types: tuple[str, ...] | None = ("message",)) -> DataFrame:
    """The ``k`` longest events of each dataset, cut at ``max_chars``; ties go to the earliest."""
    rows = measured(ev if types is None else ev.where(F.col("event_type").isin(*types)))
    best = top_k_per(rows, ["dataset_id"], k, [F.desc("chars"), F.asc("ts"), F.asc("id")])
    text = F.col("content") if max_chars is None else ellipsize(F.col("content"), max_chars)
    return best.select("dataset_id", "rank", "id", "actor", "ts", "chars", text.alias("content"))


def head_per_dataset(ev: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """The first (or newest) ``n`` events of each dataset, with rank; they are picked by time and identifier, so no other texts are sorted."""
    order = [F.desc("ts"), F.desc("id")] if newest else [F.asc("ts"), F.asc("id")]
    key = ["dataset_id", "ts", "id"]
    # Written, so that Spark knows how small it is.
    picked = materialize(top_k_per(ev.select(*key), ["dataset_id"], n, order).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct(), "picked")
    met = ev.join(picked, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left_semi")
    return top_k_per(met, ["dataset_id"], n, order)


def order_events(ev: DataFrame, desc: bool = False) -> DataFrame:
    return ev.orderBy(F.desc("ts"), F.desc("id")) if desc else ev.orderBy("ts", "id")


def primary_actor(ev: DataFrame) -> DataFrame:
    """The most frequent actor whose name isn't part of the dataset's, and its share of the events with an actor."""
    counts = ev.where("actor is not null").groupBy("dataset_id", "actor").agg(F.count(F.lit(1)).alias("messages"))
    total = F.sum("messages").over(Window.partitionBy("dataset_id"))
    fit = counts.withColumn("percentage", _share("messages", total)).where(~F.contains(F.lower("dataset_id"), F.lower("actor")))
    return top_k_per(fit, ["dataset_id"], 1, [F.desc("messages"), F.asc("actor")]).drop("rank")


def dataset_rollup(ev: DataFrame) -> DataFrame:
    return ev.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def entity_rollup(ev: DataFrame) -> DataFrame:
    """Events, characters and first and last time of each dataset's entities, told by their trimmed lower-case names."""
    e = measured(ev.where("actor is not null"))
    return e.groupBy("dataset_id", F.lower(F.trim("actor")).alias("entity")).agg(F.count(F.lit(1)).alias("events"), F.sum("chars").alias("chars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_rollup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two entity rollups as one: counts add up, times widen."""
    return old.unionByName(new).groupBy("dataset_id", "entity").agg(F.sum("events").alias("events"), F.sum("chars").alias("chars"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def corpus_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count(F.lit(1)).alias("datasets"), F.sum("events").alias("events"))
