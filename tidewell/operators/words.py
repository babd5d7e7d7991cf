"""Emoji, word, phrase, link and mention reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FREQUENCY_STOP_WORDS, TEXT_STOP_WORDS
from ..functions.text import emoji_matches, mention_matches, remove_stop_words, url_matches, word_matches
from .heavy import top_values
from .sequence import argmax, top_k_per
from .volume import named


def emojis(ev: DataFrame) -> DataFrame:
    """A row for each emoji of each event: dataset_id, id, actor, ts, emoji."""
    return ev.select("dataset_id", "id", named().alias("actor"), "ts", F.explode(emoji_matches(F.col("content"))).alias("emoji"))


def emoji_summary(ev: DataFrame) -> DataFrame:
    return emojis(ev).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("emoji").alias("distinct_emojis"))


def top_emojis(ev: DataFrame, k: int = 20) -> DataFrame:
    counts = emojis(ev).groupBy("dataset_id", "emoji").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("percentage", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("dataset_id")), 1))
    return top_k_per(share, ["dataset_id"], k, [F.desc("n"), F.asc("emoji")])


def emoji_by_person(ev: DataFrame, k: int = 5) -> DataFrame:
    counts = emojis(ev).groupBy("dataset_id", "actor", "emoji").agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy("dataset_id", "actor")))
    return top_k_per(total, ["dataset_id", "actor"], k, [F.desc("n"), F.asc("emoji")])


def emoji_over_time(ev: DataFrame) -> DataFrame:
    counts = emojis(ev).groupBy("dataset_id", F.to_date("ts").alias("date"), "emoji").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("dataset_id", "date").agg(F.sum("n").alias("total"))
    return argmax(counts, ["dataset_id", "date"], "emoji", "n", "top_emoji").drop("n").join(total, ["dataset_id", "date"])


def most_emoji_message(ev: DataFrame) -> DataFrame:
    """The event with the most emojis; the earliest where none has any, or several have as many."""
    rows = ev.withColumn("n", F.size(emoji_matches(F.col("content"))).cast("long"))
    return top_k_per(rows, ["dataset_id"], 1, [F.desc("n"), F.asc("ts"), F.asc("id")]).select("dataset_id", "id", "actor", "n")


def tokens(ev: DataFrame) -> DataFrame:
    """A row for each word of three letters or digits and more: dataset_id, id, word."""
    return ev.select("dataset_id", "id", F.explode(word_matches(F.col("content"))).alias("word"))


def _linked(word: Column) -> Column:
    return word.startswith("http") | word.startswith("www")


def word_summary(ev: DataFrame, stop_words: Iterable[str] = TEXT_STOP_WORDS) -> DataFrame:
    """All words, and distinct words that are neither stop words nor links."""
    keep = ~F.col("word").isin(list(stop_words)) & ~_linked(F.col("word"))
    return tokens(ev).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_words"), F.countDistinct(F.when(keep, F.col("word"))).alias("unique_words"))


def _surviving(c, stop_words: Iterable[str]):
    return F.filter(remove_stop_words(word_matches(c), stop_words), lambda w: ~_linked(w))


def top_words(ev: DataFrame, k: int = 100, stop_words: Iterable[str] = TEXT_STOP_WORDS) -> DataFrame:
    words = tokens(ev).where(~F.col("word").isin(list(stop_words)) & ~_linked(F.col("word")))
    return top_k_per(words.groupBy("dataset_id", "word").agg(F.count(F.lit(1)).alias("n")), ["dataset_id"], k, [F.desc("n"), F.asc("word")])


#: Signs of the texts that a task looks for equal ones among.
HELD = 1 << 23


def repeated_texts(ev: DataFrame) -> DataFrame:
    """dataset_id, content and n: events of equal texts, that come to a task near each other, as one row; nothing is shuffled for it."""
    of = {f.name: f.dataType.simpleString() for f in ev.schema}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = {}, 0, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], kind), pa.array([c for _, c in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["dataset_id", "content", "n"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in held:
                    held[key] += 1
                    continue
                held[key], size = 1, size + len(key[1])
                if size > HELD:
                    yield done()
                    held, size = {}, 0
        if held:
            yield done()

    return ev.select("dataset_id", "content").where("content is not null").mapInArrow(counted, f"dataset_id {of['dataset_id']}, content string, n long")


def top_phrases(ev: DataFrame, k: int = 50, min_count: int = 2, stop_words: Iterable[str] = TEXT_STOP_WORDS, tracked: int | None = None) -> DataFrame:
    """Pairs of words that follow each other once stop words are gone.

    ``tracked`` finds them by summaries of so many phrases and a recount, which
    doesn't shuffle the tail; it costs more time where the tail is short.
    """
    texts = ev.select("dataset_id", "content", F.lit(1).alias("n")) if tracked else repeated_texts(ev)
    kept = texts.select("dataset_id", _surviving(F.col("content"), stop_words).alias("w"), "n").where(F.size("w") > 1)
    pair = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = kept.select("dataset_id", "n", F.explode(pair).alias("phrase"))
    if tracked:
        return top_values(rows.drop("n"), ["dataset_id"], "phrase", k, min_count, tracked)
    counts = rows.groupBy("dataset_id", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return top_k_per(counts, ["dataset_id"], k, [F.desc("n"), F.asc("phrase")])


def links(ev: DataFrame) -> DataFrame:
    """A row for each link: dataset_id, url (with a scheme), domain."""
    near = ev.where(F.contains(F.lower("content"), F.lit("http")) | F.contains(F.lower("content"), F.lit("www.")))
    url = near.select("dataset_id", F.explode(url_matches(F.col("content"))).alias("u")).select("dataset_id", F.when(F.lower("u").startswith("www."), F.concat(F.lit("https://"), "u")).otherwise(F.col("u")).alias("url"))
    host = F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#:]+)", 1))
    return url.withColumn("domain", F.regexp_replace(host, r"^www\.", ""))


def top_urls(ev: DataFrame, k: int = 50) -> DataFrame:
    return top_k_per(links(ev).groupBy("dataset_id", "url").agg(F.count(F.lit(1)).alias("n")), ["dataset_id"], k, [F.desc("n"), F.asc("url")])


def top_domains(ev: DataFrame, k: int = 20) -> DataFrame:
    return top_k_per(links(ev).groupBy("dataset_id", "domain").agg(F.count(F.lit(1)).alias("n")), ["dataset_id"], k, [F.desc("n"), F.asc("domain")])


def top_mentions(ev: DataFrame, k: int = 20) -> DataFrame:
    near = ev.where(F.contains("content", F.lit("@"))).select("dataset_id", F.explode(mention_matches(F.col("content"))).alias("mention"))
    return top_k_per(near.groupBy("dataset_id", "mention").agg(F.count(F.lit(1)).alias("n")), ["dataset_id"], k, [F.desc("n"), F.asc("mention")])


def frequencies(ev: DataFrame, words: int = 100, emoji: int = 50, stop_words: Iterable[str] = FREQUENCY_STOP_WORDS) -> DataFrame:
    """Words (split at white space once other signs are gone) and emojis: kind, value, n, total, rank; totals count what the filters leave."""
    w = ev.select("dataset_id", F.lit("word").alias("kind"), F.explode(word_matches(F.col("content"))).alias("value")).where(~F.col("value").isin(list(stop_words)))
    e = emojis(ev).select("dataset_id", F.lit("emoji").alias("kind"), F.col("emoji").alias("value"))
    counts = w.unionByName(e).groupBy("dataset_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy("dataset_id", "kind")))
    ranked = top_k_per(total, ["dataset_id", "kind"], max(words, emoji), [F.desc("n"), F.asc("value")])
    return ranked.where((F.col("kind") == "word") & (F.col("rank") <= words) | (F.col("kind") == "emoji") & (F.col("rank") <= emoji))


def on_this_day(ev: DataFrame, month: int, day: int, year: int, samples: int = 10) -> DataFrame:
    """Memories of a calendar day, one row a year up to ``year``: events, participants, top emoji, first messages."""
    hit = ev.where((F.month("ts") == month) & (F.dayofmonth("ts") == day)).withColumn("year", F.year("ts"))
    base = hit.groupBy("dataset_id", "year").agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_set("actor")).alias("participants"))
    e = hit.select("dataset_id", "year", F.explode(emoji_matches(F.col("content"))).alias("emoji")).groupBy("dataset_id", "year", "emoji").agg(F.count(F.lit(1)).alias("n"))
    top = argmax(e, ["dataset_id", "year"], "emoji", "n", "top_emoji").drop("n")
    first = top_k_per(hit, ["dataset_id", "year"], samples, [F.asc("ts"), F.asc("id")]).groupBy("dataset_id", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("first_ids"))
    ago = F.greatest(F.lit(0), F.lit(year) - F.col("year")).alias("years_ago")
    return base.join(top, ["dataset_id", "year"], "left").join(first, ["dataset_id", "year"]).select("*", ago)


def on_this_day_events(ev: DataFrame, month: int, day: int, limit: int | None = 100) -> DataFrame:
    hit = ev.where((F.month("ts") == month) & (F.dayofmonth("ts") == day))
    return top_k_per(hit, ["dataset_id"], limit, [F.asc("ts"), F.asc("id")]).select("dataset_id", "rank", "id", "actor", "ts")


def contains_all(c, words: Iterable[str]):
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(c), F.lit(w.lower()))
    return out


