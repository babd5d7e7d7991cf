"""Reply pairs, threads, anomalies and print layout: what consecutive events tell."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import URGENCY_TERMS
from ..functions.terms import term_names, term_numbers
from ..functions.text import ellipsize
from ..shared import materialize
from .sequence import top_k_per, trailing_count, with_number, with_previous, with_session
from .volume import DAY, seconds

HOUR = 3600


def relationships(ev: DataFrame, initiation_gap: int = 6 * HOUR, reply_gap: int = 2 * HOUR, min_exchanges: int = 2) -> DataFrame:
    """Pairs of actors whose messages follow each other: exchanges, initiations after a silence, replies and their seconds by direction, balance."""
    rows = ev.where((F.col("event_type") == "message") & (F.coalesce("actor", F.lit("")) != "")).select("id", "dataset_id", "actor", "ts")
    met = with_previous(rows, ["actor", "ts"]).where(F.col("actor") != F.col("prev_actor")).withColumn("gap", seconds(F.col("prev_ts"), F.col("ts")))
    pair = met.withColumns({"actor_a": F.least("actor", "prev_actor"), "actor_b": F.greatest("actor", "prev_actor")})
    by_a = F.col("actor") == F.col("actor_a")
    reply, start = (F.col("gap") > 0) & (F.col("gap") <= reply_gap), F.col("gap") >= initiation_gap
    mean = lambda who: F.coalesce(F.round(F.avg(F.when(reply & who, F.round("gap")))), F.lit(0)).cast("long")
    out = pair.groupBy("dataset_id", "actor_a", "actor_b").agg(
        F.count(F.lit(1)).alias("exchanges"),
        F.count_if(start & by_a).alias("a_initiations"),
        F.count_if(start & ~by_a).alias("b_initiations"),
        F.count_if(reply & by_a).alias("a_replies"),
        F.count_if(reply & ~by_a).alias("b_replies"),
        mean(~by_a).alias("avg_secs_a_to_b"),
        mean(by_a).alias("avg_secs_b_to_a"),
    )
    a, b = F.col("a_replies") + F.col("a_initiations"), F.col("b_replies") + F.col("b_initiations")
    return out.where(F.col("exchanges") >= min_exchanges).withColumn("balance", F.coalesce(F.round(F.try_divide(a, a + b), 2), F.lit(0.5)))


def edges_between(pairs: DataFrame, min_exchanges: int = 0, name: str | None = None) -> DataFrame:
    """Relationship pairs of some weight, and with some name in them."""
    hit = pairs.where(F.col("exchanges") >= min_exchanges)
    return hit if name is None else hit.where(F.contains(F.lower("actor_a"), F.lit(name.lower())) | F.contains(F.lower("actor_b"), F.lit(name.lower())))


def threads(ev: DataFrame, gap_secs: int = 900, min_messages: int = 3, samples: int = 6, limit: int | None = 30) -> DataFrame:
    """Runs of events with gaps of ``gap_secs`` at most: size, minutes, initiator, participants, title, first messages; the ``limit`` largest, of n_threads."""
    # Texts are only read for the titles of the largest.
    run = with_session(ev.select("id", "dataset_id", "actor", "ts"), gap_secs)
    first = F.min(F.struct("ts", "id", "actor"))
    rows = run.groupBy("dataset_id", "session").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        first.alias("_first"),
        F.array_sort(F.collect_set(F.when(F.coalesce("actor", F.lit("System")) != "System", F.col("actor")))).alias("participants"),
    ).where(F.col("messages") >= min_messages)
    total = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_threads"))
    best = top_k_per(rows, ["dataset_id"], limit, [F.desc("messages"), F.asc("start_ts")]).join(total, "dataset_id")
    shown = run.join(best.select("dataset_id", "session"), ["dataset_id", "session"], "left_semi")
    sample = top_k_per(shown, ["dataset_id", "session"], samples, [F.asc("ts"), F.asc("id")]).groupBy("dataset_id", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("sample_ids"))
    title = ev.select(F.col("dataset_id").alias("_d"), F.col("id").alias("_id"), F.col("ts").alias("_ts"), ellipsize(F.col("content"), 60).alias("title"))
    opened = best.join(sample, ["dataset_id", "session"])
    return opened.join(title, (F.col("dataset_id") == F.col("_d")) & (F.col("session.id") == F.col("_id")) & (F.col("session.ts") == F.col("_ts"))).select(
        "dataset_id", "rank", "n_threads", F.col("session.id").alias("first_id"), "messages", "start_ts", "end_ts",
        F.greatest(F.lit(1), F.round(seconds(F.col("start_ts"), F.col("end_ts")) / 60)).cast("long").alias("minutes"),
        F.coalesce("_first.actor", F.lit("Unknown")).alias("initiator"), "participants", "title", "sample_ids",
    )


def _anomaly(df: DataFrame, kind: str, severity: Column, ts: Column, end: Column, actor: Column, metric: Column, detail: Column) -> DataFrame:
    return df.select(
        "dataset_id", F.lit(kind).alias("type"), severity.alias("severity"), ts.cast("timestamp").alias("ts"), end.cast("timestamp").alias("end_ts"),
        actor.alias("actor"), metric.cast("double").alias("metric"), detail.alias("detail"),
    )


def _earliest(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else top_k_per(df, ["dataset_id"], limit, [F.asc("ts"), F.asc("detail")]).drop("rank")


def late_night_surges(ev: DataFrame, least: int = 15, factor: float = 1.5, critical: int = 40, limit: int | None = 15) -> DataFrame:
    """Hours from midnight to five with many events for the dataset's mean."""
    total = ev.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), (seconds(F.min("ts"), F.max("ts")) / HOUR).alias("span"))
    base = total.select("dataset_id", F.greatest(F.lit(1.0), F.col("n") / F.greatest(F.lit(24.0), F.col("span"))).alias("base"))
    night = ev.where(F.hour("ts") < 5).groupBy("dataset_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id", "actor")).alias("f"))
    hit = night.join(base, "dataset_id").where((F.col("n") >= least) & (F.col("n") > factor * F.col("base")))
    sev = F.when(F.col("n") >= critical, F.lit("CRITICAL")).otherwise(F.lit("WARNING"))
    out = _anomaly(hit, "LATE_NIGHT_SURGE", sev, F.col("f.ts"), F.col("h") + F.expr("interval 1 hour"), F.coalesce("f.actor", F.lit("Unknown")), F.col("n"), F.date_format("h", "yyyy-MM-dd HH:mm"))
    return _earliest(out, limit)


def velocity_bursts(ev: DataFrame, least: int = 25, window_secs: int = 300, critical: int = 50, limit: int | None = 15) -> DataFrame:
    """Stretches in which the last ``window_secs`` always held ``least`` events and more; the metric is the peak."""
    busy = trailing_count(ev.select("id", "dataset_id", "actor", "ts"), window_secs).where(F.col("recent") >= least)
    run = with_session(busy, window_secs).groupBy("dataset_id", "session").agg(F.max("recent").alias("peak"), F.min("ts").alias("a"), F.max(F.struct("ts", "id", "actor")).alias("z"))
    sev = F.when(F.col("peak") >= critical, F.lit("CRITICAL")).otherwise(F.lit("WARNING"))
    return _earliest(_anomaly(run, "VELOCITY_BURST", sev, F.col("a"), F.col("z.ts"), F.coalesce("z.actor", F.lit("Multiple Participants")), F.col("peak"), F.col("session.id").cast("string")), limit)


def greedy_bursts(ev: DataFrame, least: int = 25, window_secs: int = 300, restart: int = 10, block: int = 100_000) -> DataFrame:
    """The other reading of a burst: a window that reports as soon as it holds ``least`` events and then starts ``restart`` events later.

    Returns dataset_id, start_ts, end_ts and messages. Where a window may start
    is told by an event and the one ``least`` - 1 after it; from one report the
    next is the first such start a few events on. A block of events thus sends
    each of few places of entry to a place of entry of the next block, and these
    functions are composed by doubling, so a stream without any pause is as many
    tasks as it has blocks. ``least`` is 2 or more, ``restart`` 1 or more.
    """
    if least < 2 or restart < 1:
        raise ValueError("a burst has two events and more, and the next one starts later")
    size, step, key = max(block, least), min(restart, least - 1), ["dataset_id", "block"]
    at = F.col("n") - 1
    own = F.floor(at / size).cast("long")
    rows = with_number(ev.select("dataset_id", "id", F.col("ts").cast("timestamp").alias("ts")))
    # A block's last events are followed by the next one's first, which it gets as well.
    spread = rows.select("dataset_id", "ts", at.alias("at"), F.explode(F.when((at % size < least - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))).alias("block"))
    ends = spread.withColumn("end", F.lead("ts", least - 1).over(Window.partitionBy(*key).orderBy("at")))
    hot = ends.where((F.floor(F.col("at") / size) == F.col("block")) & (seconds(F.col("ts"), F.col("end")) <= window_secs))
    hot = materialize(hot.select(*key, (F.col("at") % size).cast("int").alias("at"), "ts", "end"), "burst-starts")

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(pdf["at"].to_numpy())
        following = np.searchsorted(starts, starts + step)
        leave = np.maximum(starts + step - size, 0)
        for i in range(len(starts) - 1, -1, -1):
            if following[i] < len(starts):
                leave[i] = leave[following[i]]
        entered = np.searchsorted(starts, np.arange(step))
        out = np.where(entered < len(starts), leave[np.minimum(entered, len(starts) - 1)], 0)
        return pd.DataFrame({"dataset_id": pdf["dataset_id"].iloc[:1], "block": pdf["block"].iloc[:1], "leads": [out.astype(np.int32)]})

    through = materialize(hot.groupBy(*key).applyInPandas(jumps, "dataset_id string, block long, leads array<int>"), "burst-jumps")
    last, reach = through.agg(F.max("block")).first()[0], 1
    while last is not None and reach <= last:
        before = through.select("dataset_id", (F.col("block") + reach).alias("block"), F.col("leads").alias("earlier"))
        # A block without any start leads to the next one's first event.
        earlier = F.coalesce("earlier", F.array_repeat(F.lit(0), step))
        met = through.join(before, key, "left").select(*key, F.when(F.col("block") < reach, F.col("leads")).otherwise(F.transform(earlier, lambda x: F.get("leads", x))).alias("leads"))
        through, reach = materialize(met, "burst-jumps"), reach * 2
    entry = through.select("dataset_id", (F.col("block") + 1).alias("block"), F.get("leads", F.lit(0)).alias("entry"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        starts, i, taken = pdf["at"].to_numpy(), int(pdf["entry"].iloc[0]), []
        while (k := int(np.searchsorted(starts, i))) < len(starts):
            taken.append(k)
            i = int(starts[k]) + step
        return pdf.iloc[taken][["dataset_id", "ts", "end"]].rename(columns={"ts": "start_ts", "end": "end_ts"}).assign(messages=least)

    met = hot.join(entry, key, "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return met.groupBy(*key).applyInPandas(follow, "dataset_id string, start_ts timestamp, end_ts timestamp, messages long")


def dormancy_gaps(ev: DataFrame, days: float = 14, warning: float = 45, limit: int | None = 10) -> DataFrame:
    """Silences of ``days`` and more between consecutive events."""
    met = with_previous(ev.select("id", "dataset_id", "actor", "ts"), ["ts"]).withColumn("gap", seconds(F.col("prev_ts"), F.col("ts")) / DAY).where(F.col("gap") >= days)
    sev = F.when(F.col("gap") >= warning, F.lit("WARNING")).otherwise(F.lit("NOTE"))
    return _earliest(_anomaly(met, "DORMANCY_GAP", sev, F.col("prev_ts"), F.col("ts"), F.col("actor"), F.round("gap"), F.col("id").cast("string")), limit)


def matched_terms(c: Column, terms: Iterable[str], whole_word: bool = False) -> Column:
    """The terms that a text contains, in their order."""
    terms = list(terms)
    return term_names(term_numbers(c, terms, whole_word), terms)


def urgency_spikes(ev: DataFrame, terms: Iterable[str] = URGENCY_TERMS, least: int = 2, critical: int = 3, limit: int | None = 15) -> DataFrame:
    hit = ev.select("id", "dataset_id", "actor", "ts", matched_terms(F.col("content"), terms).alias("terms")).where(F.size("terms") >= least)
    sev = F.when(F.size("terms") >= critical, F.lit("CRITICAL")).otherwise(F.lit("WARNING"))
    return _earliest(_anomaly(hit, "URGENCY_SPIKE", sev, F.col("ts"), F.col("ts"), F.col("actor"), F.size("terms"), F.concat_ws("|", F.col("id").cast("string"), F.array_join("terms", ", "))), limit)


def ghost_participants(ev: DataFrame, span_days: float = 30, least: int = 30, active_days: float = 5, limit: int | None = 10) -> DataFrame:
    """Actors with many events within a few days of a long stream."""
    span = ev.groupBy("dataset_id").agg((seconds(F.min("ts"), F.max("ts")) / DAY).alias("span")).where(F.col("span") > span_days)
    who = ev.where((F.coalesce("actor", F.lit("")) != "") & (F.col("actor") != "System")).groupBy("dataset_id", "actor").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    hit = who.where((F.col("n") >= least) & (seconds(F.col("a"), F.col("z")) / DAY <= active_days)).join(span, "dataset_id")
    return _earliest(_anomaly(hit, "GHOST_PARTICIPANT", F.lit("NOTE"), F.col("a"), F.col("z"), F.col("actor"), F.col("n"), F.col("actor")), limit)


def anomalies(ev: DataFrame, min_events: int = 5, bursts: dict | None = None, surges: dict | None = None, gaps: dict | None = None, urgency: dict | None = None, ghosts: dict | None = None) -> DataFrame:
    """All anomalies of datasets with ``min_events`` and more; ``weight`` orders severities."""
    big = ev.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events).select("dataset_id")
    parts = [late_night_surges(ev, **(surges or {})), velocity_bursts(ev, **(bursts or {})), dormancy_gaps(ev, **(gaps or {})), urgency_spikes(ev, **(urgency or {})), ghost_participants(ev, **(ghosts or {}))]
    rows = reduce(DataFrame.unionByName, parts).join(big, "dataset_id", "left_semi")
    return rows.withColumn("weight", F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "WARNING", 2).otherwise(1))


def ordered_anomalies(rows: DataFrame, types: Iterable[str] | None = None, severities: Iterable[str] | None = None) -> DataFrame:
    """Anomalies by severity and then newest first, of some types and severities."""
    hit = rows if types is None else rows.where(F.col("type").isin(list(types)))
    hit = hit if severities is None else hit.where(F.col("severity").isin(list(severities)))
    return hit.orderBy(F.desc("weight"), F.desc("ts"), "type", "detail")


def anomaly_counts(rows: DataFrame) -> DataFrame:
    at = lambda s: F.count_if(F.col("severity") == s)
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total"), at("CRITICAL").alias("critical"), at("WARNING").alias("warning"), at("NOTE").alias("note"))


def layout_events(ev: DataFrame, primary: DataFrame, group_secs: int = 300) -> DataFrame:
    """Flags for printing: first of a group (another actor, day, or a pause), new day, new month, sent by the primary actor."""
    met = with_previous(ev, ["actor", "ts"]).join(primary.select("dataset_id", F.col("actor").alias("_p")), "dataset_id", "left")
    d = F.to_date("ts")
    new_day = F.col("prev_ts").isNull() | (d != F.to_date("prev_ts"))
    same = F.col("actor").eqNullSafe(F.col("prev_actor")) & (seconds(F.col("prev_ts"), F.col("ts")) <= group_secs) & ~new_day
    return met.select(
        "dataset_id", "id", "ts", "actor", (~F.coalesce(same, F.lit(False))).alias("is_first_in_group"), new_day.alias("new_day"),
        (F.col("prev_ts").isNull() | (F.date_trunc("month", "ts") != F.date_trunc("month", "prev_ts"))).alias("new_month"), F.coalesce(F.col("actor") == F.col("_p"), F.lit(False)).alias("is_sent"),
    )
