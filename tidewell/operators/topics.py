"""Topics, insights, and what two streams have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TOPICS
from ..functions.terms import term_names, term_numbers
from ..functions.text import pearson
from ..shared import materialize
from . import volume, words
from .sequence import top_k_per
from .volume import DAY, seconds


def _between(numbers: str, lo: int, hi: int) -> Column:
    return F.filter(numbers, lambda h: (h >= lo) & (h < hi))


def assign_topics(ev: DataFrame, topics: dict[str, tuple[str, list[str]]] = TOPICS, whole_word: bool = False) -> DataFrame:
    """Adds topic, the one with most of its terms in the text (ties: the first), or general, and the terms.

    All topics' terms are looked for in one pass over a text.
    """
    listed = [t for _, terms in topics.values() for t in terms]
    hits = ev.withColumn("_hits", term_numbers(F.col("content"), listed, whole_word))
    made, at = [], 0
    for i, (name, (_, terms)) in enumerate(topics.items()):
        own = _between("_hits", at, at + len(terms))
        made.append(F.struct(F.size(own).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name"), own.alias("own")))
        at += len(terms)
    best = hits.withColumn("_b", F.array_max(F.array(*made)))
    some = F.col("_b.n") > 0
    return best.select(*ev.columns, F.when(some, F.col("_b.name")).otherwise(F.lit("general")).alias("topic"), F.when(some, term_names(F.col("_b.own"), listed)).otherwise(F.array().cast("array<string>")).alias("terms"))


def topic_report(assigned: DataFrame, keywords: int = 10, actors: int = 5, samples: int = 5) -> DataFrame:
    """Events, share, keywords, actors and first events of each topic."""
    key = ["dataset_id", "topic"]
    assigned = materialize(assigned.select(*key, "id", "actor", "ts", "terms"), "topics")  # five aggregates read it
    counts = assigned.groupBy(*key).agg(F.count(F.lit(1)).alias("messages"))
    total = assigned.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = lambda df, col, out: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda s: s[col]).alias(out))
    n = F.count(F.lit(1)).alias("n")
    term = top_k_per(assigned.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(n), key, keywords, [F.desc("n"), F.asc("term")])
    who = top_k_per(assigned.where("actor is not null and topic <> 'general'").groupBy(*key, "actor").agg(n), key, actors, [F.desc("n"), F.asc("actor")])
    first = top_k_per(assigned.select(*key, "ts", "id"), key, samples, [F.asc("ts"), F.asc("id")])
    none = F.array().cast("array<string>")
    return (
        counts.join(total, "dataset_id").join(listed(term, "term", "keywords"), key, "left").join(listed(who, "actor", "top_actors"), key, "left").join(listed(first, "id", "sample_ids"), key)
        .select(*key, "messages", F.round(100.0 * F.col("messages") / F.col("_n"), 1).alias("percentage"),
                F.when(F.col("topic") == "general", F.array(F.lit("chat"))).otherwise(F.coalesce("keywords", none)).alias("keywords"), F.coalesce("top_actors", none).alias("top_actors"), "sample_ids")
    )


def insights(ev: DataFrame) -> DataFrame:
    """One row for each rule that holds in a dataset: rule (its number), category, title, summary, confidence, importance, support."""
    grouped = lambda c: F.format_number(c, 0)
    text = lambda c: c.cast("string")

    def row(df: DataFrame, rule: int, category: str, title: str, summary, confidence: float, importance: str, support: dict) -> DataFrame:
        items = [x for k, v in support.items() for x in (F.lit(k), text(v))]
        return df.select("dataset_id", F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(title).alias("title"), summary.alias("summary"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"), F.create_map(*items).alias("support"))

    c = F.col
    person = top_k_per(volume.by_person(ev), ["dataset_id"], 1, [F.desc("messages"), F.asc("actor")]).where("percentage >= 30")
    peak, dow, hour = volume.peaks(ev), volume.by_weekday(ev), volume.by_hour(ev)
    total = ev.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total"))
    late = hour.groupBy("dataset_id").agg(F.sum(F.when(c("hour").isin(22, 23, 0, 1, 2, 3, 4), c("messages")).otherwise(0)).alias("late")).join(total, "dataset_id").withColumn("pct", F.round(100.0 * c("late") / c("total"), 1))
    day = peak.join(dow.select("dataset_id", c("dow").alias("peak_dow"), "day_name", "percentage"), ["dataset_id", "peak_dow"])
    early = peak.join(late.where("pct < 25"), "dataset_id")
    emoji = words.top_emojis(ev, 1).join(words.emoji_summary(ev), "dataset_id")
    streak = volume.longest_streak(ev).where("days > 1")
    busy = peak.join(volume.activity_summary(ev), "dataset_id")
    fast = volume.fastest_responder(ev, "median", 5)
    label = F.when(c("median_secs") < 60, F.concat(text(c("median_secs")), F.lit(" seconds"))).otherwise(F.concat(text(F.round(c("median_secs") / 60).cast("long")), F.lit(" minutes")))
    parts = [
        row(person, 1, "participant", "Primary Contributor", F.concat(c("actor"), F.lit(" sent "), text(c("percentage")), F.lit("% of all messages ("), grouped(c("messages")), F.lit(" messages).")), 1.0, "high", {"actor": c("actor"), "count": c("messages"), "percentage": c("percentage")}),
        row(day, 2, "timing", "Peak Weekly Activity", F.concat(F.lit("You were most active on "), c("day_name"), F.lit(", accounting for "), text(c("percentage")), F.lit("% of all messages.")), 0.95, "medium", {"day": c("day_name"), "count": c("dow_messages"), "percentage": c("percentage")}),
        row(late.where("pct >= 25"), 3, "timing", "Night Owl Tendency", F.concat(F.lit("Night owl habits detected: "), text(c("pct")), F.lit("% of conversation activity occurred between 10 PM and 5 AM.")), 0.9, "medium", {"count": c("late"), "percentage": c("pct")}),
        row(early, 3, "timing", "Peak Daily Hour", F.concat(F.lit("Activity peaks at "), c("hour_label"), F.lit(" with "), grouped(c("hour_messages")), F.lit(" messages sent.")), 0.9, "low", {"hour": c("peak_hour"), "count": c("hour_messages")}),
        row(emoji, 4, "emoji", "Favorite Emoji", F.concat(c("emoji"), F.lit(" was the most frequently used emoji, appearing "), grouped(c("n")), F.lit(" times ("), text(c("percentage")), F.lit("% of all emojis).")), 1.0, "medium", {"emoji": c("emoji"), "count": c("n"), "percentage": c("percentage")}),
        row(streak, 5, "streak", "Longest Active Streak", F.concat(F.lit("Your longest conversation streak was "), text(c("days")), F.lit(" consecutive days (from "), text(c("start_date")), F.lit(" to "), text(c("end_date")), F.lit(").")), 1.0, "high", {"days": c("days"), "start": c("start_date"), "end": c("end_date")}),
        row(busy, 6, "activity", "Busiest Day Record", F.concat(F.lit("The highest message volume in a single day was "), grouped(c("date_messages")), F.lit(" messages on "), text(c("peak_date")), F.lit(".")), 1.0, "medium", {"date": c("peak_date"), "count": c("date_messages"), "average": c("avg_per_active_day")}),
        row(fast, 7, "participant", "Fastest Responder", F.concat(c("actor"), F.lit(" was the quickest to respond, with a median response time of "), label, F.lit(".")), 0.85, "low", {"actor": c("actor"), "median": c("median_secs"), "samples": c("samples")}),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- two streams


def side(ev: DataFrame, dataset: str) -> DataFrame:
    return ev.where(F.col("dataset_id") == dataset)


def participant_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names that both sides have, by their trimmed lower case: a's spelling and both counts."""
    x = volume.by_person(a).select(F.lower(F.trim("actor")).alias("k"), F.col("actor").alias("name"), F.col("messages").alias("messages_a"))
    y = volume.by_person(b).groupBy(F.lower(F.trim("actor")).alias("k")).agg(F.max("messages").alias("messages_b"))
    return x.join(y, "k").select("name", "messages_a", "messages_b")


def _paired(a: DataFrame, b: DataFrame, col: str, k: int, out: int | None) -> DataFrame:
    met = a.select(col, F.col("n").alias("n_a")).join(b.select(col, F.col("n").alias("n_b")), col).withColumn("n", F.col("n_a") + F.col("n_b"))
    return met.orderBy(F.desc("n"), F.asc(col)).limit(out) if out else met


def shared_keywords(a: DataFrame, b: DataFrame, k: int = 100, out: int = 30) -> DataFrame:
    return _paired(words.top_words(a, k), words.top_words(b, k), "word", k, out)


def unique_keywords(a: DataFrame, b: DataFrame, k: int = 100, out: int = 20) -> DataFrame:
    """Words of a's top ``k`` that aren't in b's."""
    return words.top_words(a, k).join(words.top_words(b, k), "word", "left_anti").orderBy(F.desc("n"), F.asc("word")).limit(out).select("word", "n")


def shared_emojis(a: DataFrame, b: DataFrame, k: int = 20, out: int = 15) -> DataFrame:
    return _paired(words.top_emojis(a, k), words.top_emojis(b, k), "emoji", k, out)


def concurrent_days(a: DataFrame, b: DataFrame) -> DataFrame:
    days = lambda e: e.select(F.to_date("ts").alias("date"))
    return days(a).intersect(days(b)).agg(F.count(F.lit(1)).alias("days"))


def temporal_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    ends = lambda e, s: e.agg(F.min("ts").alias(f"start_{s}"), F.max("ts").alias(f"end_{s}"))
    both = ends(a, "a").crossJoin(ends(b, "b")).crossJoin(concurrent_days(a, b))  # one row each
    secs = F.greatest(F.lit(0.0), seconds(F.greatest("start_a", "start_b"), F.least("end_a", "end_b")))
    span = seconds(F.least("start_a", "start_b"), F.greatest("end_a", "end_b"))
    return both.select(
        F.round(secs / DAY).cast("long").alias("overlap_days"), F.coalesce(F.round(F.try_divide(100.0 * secs, span), 1), F.lit(0.0)).alias("overlap_percentage"), F.col("days").alias("concurrent_days")
    )


def hourly_synchronicity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of the two sides' events by hour, clamped and rounded."""
    x, y = (volume.by_hour(e).groupBy("hour").agg(F.sum("messages").cast("double").alias(c)) for e, c in ((a, "x"), (b, "y")))
    s = x.join(y, "hour").agg(*[F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    r = pearson(F.lit(24.0), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return s.select(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 2).alias("synchronicity"))


def correlate(ev: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    x, y = side(ev, a), side(ev, b)
    return {
        "participants": participant_overlap(x, y), "overlap": temporal_overlap(x, y), "synchronicity": hourly_synchronicity(x, y), "shared_keywords": shared_keywords(x, y),
        "unique_a": unique_keywords(x, y), "unique_b": unique_keywords(y, x), "shared_emojis": shared_emojis(x, y), "sides": volume.volume_summary(ev.where(F.col("dataset_id").isin(a, b))),
    }


def correlate_all(ev: DataFrame) -> DataFrame:
    """Shared actors, concurrent days and hourly synchronicity of all pairs of datasets."""
    pair = lambda df, on: df.alias("x").join(df.alias("y"), F.expr(f"x.{on} = y.{on} and x.dataset_id < y.dataset_id")).select(F.col("x.dataset_id").alias("a"), F.col("y.dataset_id").alias("b"), F.col(f"x.{on}").alias("k"))
    who = ev.where("actor is not null").select("dataset_id", F.lower(F.trim("actor")).alias("who")).distinct()
    people = pair(who, "who").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_actors"))
    dates = pair(volume.by_date(ev), "date").groupBy("a", "b").agg(F.count(F.lit(1)).alias("concurrent_days"))
    h = volume.by_hour(ev).withColumn("m", F.col("messages").cast("double"))
    met = h.alias("x").join(h.alias("y"), F.expr("x.hour = y.hour and x.dataset_id < y.dataset_id"))
    x, y = F.col("x.m"), F.col("y.m")
    r = pearson(F.lit(24.0), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    sync = met.groupBy(F.col("x.dataset_id").alias("a"), F.col("y.dataset_id").alias("b")).agg(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 2).alias("synchronicity"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sync.join(people, ["a", "b"], "left").join(dates, ["a", "b"], "left").select("a", "b", zero("shared_actors"), zero("concurrent_days"), "synchronicity")
