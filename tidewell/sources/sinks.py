"""Written tables and exports of events, and the manifest that verifies them."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import relations, topics, volume, words
from ..operators.normalize import normalize
from ..operators.sequence import top_k_per, with_number, with_previous
from ..shared import discard, materialize, remove


def write_events(ev: DataFrame, path: str, mode: str = "append") -> None:
    """Events as Parquet by dataset, in zstd; rows of a dataset are sorted by time within a file."""
    ev.sortWithinPartitions("dataset_id", "ts").write.mode(mode).option("compression", "zstd").partitionBy("dataset_id").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop_dataset(spark: SparkSession, path: str, dataset_id: str) -> None:
    """Deletes a dataset's events: its folder is replaced by nothing."""
    remove(spark, f"{path}/dataset_id={dataset_id}")


def load(records: DataFrame, dataset_id: str, path: str, default_ts=None) -> tuple[int, int]:
    """Loads records as a dataset's events below ``path``, rejects beside them: (events, rejects).

    A bad record is counted and kept apart, and the load goes on; a load without
    one good record is an error and leaves nothing. A second load replaces the first.
    """
    spark = records.sparkSession
    events, rejects = normalize(records, dataset_id, default_ts, count_lines=True)
    good, bad = f"{path}/events/dataset_id={dataset_id}", f"{path}/rejects/dataset_id={dataset_id}"
    events.drop("dataset_id").sortWithinPartitions("ts").write.mode("overwrite").option("compression", "zstd").parquet(good)
    rejects.write.mode("overwrite").option("compression", "zstd").parquet(bad)
    n, lost = (spark.read.parquet(at).count() for at in (good, bad))
    if not n:
        remove(spark, good)
        remove(spark, bad)
        raise ValueError(f"{dataset_id}: none of {lost} records could be loaded")
    return n, lost


def metrics_table(ev: DataFrame) -> DataFrame:
    """dataset_id, name, category, value: messages, words, emojis, longest streak and active days."""
    vol = volume.volume_summary(ev).select("dataset_id", F.col("messages").alias("total_messages"), F.col("words").alias("total_words"))
    rest = [
        words.emoji_summary(ev).select("dataset_id", F.col("total").alias("total_emojis")),
        volume.longest_streak(ev).select("dataset_id", F.col("days").alias("longest_streak_days")),
        volume.activity_summary(ev).select("dataset_id", "active_days"),
    ]
    for r in rest:
        vol = vol.join(r, "dataset_id", "left")
    names = [c for c in vol.columns if c != "dataset_id"]
    wide = vol.select("dataset_id", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in names])
    return wide.unpivot("dataset_id", names, "name", "value").select("dataset_id", "name", F.when(F.col("name").isin("longest_streak_days", "active_days"), F.lit("activity")).otherwise(F.lit("volume")).alias("category"), "value")


def highlights_table(insights: DataFrame) -> DataFrame:
    score = F.when(F.col("importance") == "high", 3.0).when(F.col("importance") == "medium", 2.0).otherwise(1.0)
    return insights.select("dataset_id", "title", F.col("summary").alias("description"), score.alias("score"), F.to_json("support").alias("metadata"))


def list_datasets(rollup: DataFrame, metrics: DataFrame) -> DataFrame:
    """Datasets with their metrics as a map, newest first."""
    m = metrics.groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    return rollup.join(m, "dataset_id", "left").orderBy(F.desc("last_ts"), "dataset_id")


#: Texts keep white space at their ends.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(ev: DataFrame, path: str) -> None:
    """Nine columns in the order of time, quoted, in gzip; nulls are empty fields."""
    cols = ["id", "ts", "actor", "event_type", "content", "char_length", "word_count", "has_urls", "has_media"]
    ev.orderBy("ts", "id").select(*[F.col(c) if c in ev.columns else F.lit(None).cast("string").alias(c) for c in cols]).write.options(**CSV, quoteAll=True, compression="gzip").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``export_csv`` as texts, sign by sign; empty fields are null. Without a sign to escape quotes' escapes, the reader drops NULs before quotes."""
    return spark.read.options(**CSV, multiLine=True, lineSep="\n", charToEscapeQuoteEscaping='"').csv(path)


def export_json(ev: DataFrame, path: str) -> None:
    """Events as JSON lines in the order of time, in gzip, and the datasets beside them."""
    ev.orderBy("ts", "id").write.option("compression", "gzip").json(f"{path}/events")
    volume.dataset_rollup(ev).write.json(f"{path}/datasets")


#: Messages of a part of a month.
PART = 5_000


@F.arrow_udf(BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    """Texts in zstd, each after its length in bytes, so that shuffles and spills of them are about half as large."""
    return pa.array([b.size.to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True) for b in (t.as_buffer() for t in text)], pa.binary())


def _unpacked(packed: pa.Scalar) -> bytes:
    b = packed.as_buffer()
    return pa.decompress(b.slice(8), int.from_bytes(b.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True)


def _month() -> Column:
    return F.date_format("ts", "yyyy-MM")


def _day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def _hour() -> Column:
    return F.date_trunc("hour", "ts")


def _month_lines(ev: DataFrame) -> DataFrame:
    """dataset_id, ts, id and the Markdown of each message, packed."""
    line = F.concat(F.lit("**"), F.coalesce("actor", F.lit("System")), F.lit("** "), F.date_format("ts", "HH:mm"), F.lit("\n> "), F.replace(F.col("content"), F.lit("\n"), F.lit("\n> ")))
    return ev.where("dataset_id is not null and ts is not null").select("dataset_id", "ts", "id", _packed(F.coalesce(line, F.lit(""))).alias("packed"))


def _days(ev: DataFrame) -> DataFrame:
    """Each day's number of messages before it in its month (_before), and the month's front matter; the columns begin with _."""
    sizes = ev.where("dataset_id is not null and ts is not null").groupBy("dataset_id", _month().alias("month"), _day().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    whole, earlier = Window.partitionBy("dataset_id", "month"), Window.partitionBy("dataset_id", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    stamp = lambda c: F.date_format(c.over(whole), "yyyy-MM-dd HH:mm:ss")
    front = F.concat(F.lit("---\nmonth: "), "month", F.lit("\nmessages: "), F.sum("n").over(whole).cast("string"), F.lit("\nfirst: "), stamp(F.min("a")), F.lit("\nlast: "), stamp(F.max("z")), F.lit("\n---\n\n"))
    return sizes.select(F.col("dataset_id").alias("_d"), F.col("month").alias("_m"), F.col("day").alias("_day"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), front.alias("_front"))


def _part_hours(ev: DataFrame, size: int) -> DataFrame:
    """What tells the parts of an hour's messages, by the order of messages without their texts.

    Columns _d, _h, base (the part before the hour's first message), starts
    (first messages of parts in the hour, with ``same``, how many of the part
    before are equal to it in time and identifier), opens (the day's first
    message, if here) and front.
    """
    order = Window.partitionBy("dataset_id", "day").orderBy("ts", "id")
    slim = ev.where("dataset_id is not null and ts is not null").select("dataset_id", "ts", "id", _day().alias("day"))
    own = slim.withColumns({"k": F.row_number().over(order), "same": F.row_number().over(order) - F.rank().over(order)})
    met = own.join(_days(ev), (F.col("dataset_id") == F.col("_d")) & (F.col("day") == F.col("_day"))).withColumn("at", F.col("_before") + F.col("k") - 1)
    start = F.when(F.col("at") % size == 0, F.struct(F.struct("ts", "id").alias("first"), F.col("same").cast("long").alias("same"), "at"))
    base = F.floor((F.min("at") - 1) / size).cast("int")
    return met.groupBy(F.col("dataset_id").alias("_d"), _hour().alias("_h")).agg(
        base.alias("base"), F.array_sort(F.collect_list(start), lambda x, y: (x["at"] - y["at"]).cast("int")).alias("starts"), F.min(F.when(F.col("k") == 1, F.struct("ts", "id"))).alias("opens"), F.first("_front").alias("front")
    )


def month_parts(ev: DataFrame, size: int = PART) -> DataFrame:
    """Each month's Markdown in ordered parts of ``size`` messages: dataset_id, month, part (from 0), messages, text.

    The first part begins with the month's front matter, a day's first message
    with its heading. Joined by blank lines, the parts are the month's page; no
    part grows with the month or the day. Texts are shuffled once, packed: where
    parts begin is told before, by the order of messages without texts.
    """
    hours = materialize(_part_hours(ev, size), "part-hours")  # so Spark knows its size, and texts needn't be shuffled to meet it
    met = _month_lines(ev).join(hours, (F.col("dataset_id") == F.col("_d")) & (_hour() == F.col("_h")))
    own = F.struct("ts", "id")
    # Messages equal in time and identifier, between which a part begins, go to both parts, which take as many as they have.
    below = F.size(F.filter("starts", lambda s: (s["first"] < own) | ((s["first"] == own) & (s["same"] == 0))))
    until = F.size(F.filter("starts", lambda s: s["first"] <= own))
    dealt = met.withColumn("part", F.explode(F.sequence(F.col("base") + below, F.col("base") + until)))
    begins = F.get("starts", F.col("part") - F.col("base") - 1)
    rows = dealt.select("dataset_id", _month().alias("month"), "part", "ts", "id", _day().alias("day"), F.coalesce(F.when(begins["first"] == own, begins["same"]), F.lit(0)).alias("skip"),
                        F.coalesce(F.col("opens") == own, F.lit(False)).alias("opening"), F.when(F.col("part") == 0, F.col("front")).otherwise(F.lit("")).alias("front"), "packed")

    def joined(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [("ts", "ascending"), ("id", "ascending")], null_placement="at_start")
        skip = rows["skip"][order[0].as_py()].as_py()
        rows = rows.take(order.slice(skip, size))
        front, opening, days = rows["front"][0].as_py(), skip == 0 and rows["opening"][0].as_py(), rows["day"].to_pylist()
        heads = [f"## {d}\n\n".encode() if (d != days[i - 1] if i else opening) else b"" for i, d in enumerate(days)]
        text = front.encode() + b"\n\n".join(head + _unpacked(p) for head, p in zip(heads, rows["packed"]))
        one = rows.slice(0, 1)
        return pa.table({"dataset_id": one["dataset_id"], "month": one["month"], "part": one["part"], "messages": [len(days)], "text": [text.decode()]})

    return rows.groupBy("dataset_id", "month", "part").applyInArrow(joined, "dataset_id string, month string, part int, messages long, text string")


@cache
def _crypto():
    """OpenSSL's library, or None where it isn't there by this name."""
    try:
        found = ctypes.CDLL("libcrypto.so.3")
        return found if all(hasattr(found, f"SHA256_{f}") for f in ("Init", "Update", "Final")) else None
    except OSError:
        return None


class _Sha256:
    """SHA-256 whose state, which hashlib keeps to itself, can go on in another task."""

    def __init__(self, state: bytes | None = None):
        self.state = ctypes.create_string_buffer(state or b"", 128)  # its struct has 112 bytes
        if state is None:
            _crypto().SHA256_Init(self.state)

    def update(self, b: bytes) -> None:
        _crypto().SHA256_Update(self.state, b, ctypes.c_size_t(len(b)))

    def hexdigest(self) -> str:
        out, state = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state.raw, 128)
        _crypto().SHA256_Final(out, state)
        return out.raw.hex()


#: Messages whose texts are shuffled for digests at once, by whole days.
ROUND = 4_000_000


def _rounds(ev: DataFrame, size: int) -> list[tuple[int, int]]:
    """First and last days (from 1970) of stretches of ``size`` messages, or one day, at most."""
    on = F.unix_date(F.to_date("ts"))
    days = ev.where("dataset_id is not null and ts is not null").groupBy(on.alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()  # a row a day
    out, n = [], 0
    for d in days:
        if out and n + d["n"] <= size:
            out[-1], n = (out[-1][0], d["day"]), n + d["n"]
        else:
            out.append((d["day"], d["day"]))
            n = d["n"]
    return out


def _digests_in_rounds(ev: DataFrame, rounds: list[tuple[int, int]]) -> DataFrame:
    """``month_digests`` by stretches of days: a month's digest goes on from round to round, and what a round shuffled is deleted before the next one."""
    key = ["dataset_id", "month"]
    days = materialize(_days(ev).where("_before = 0").select(F.col("_d").alias("dataset_id"), F.col("_m").alias("month"), F.unix_date(F.to_date("_day")).alias("_on"), "_front"), "fronts")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda: pa.RecordBatch.from_pydict({"dataset_id": [key[0]], "month": [key[1]], "messages": [n], "day": [day], "state": [digest.state.raw]})
        key, day, n, digest = None, None, 0, None
        for b in batches:
            for dataset, month, kind, on, before, packed in zip(*(b[c].to_pylist() for c in ("dataset_id", "month", "kind", "day", "messages")), b["packed"]):
                if key != (dataset, month):
                    if key:
                        yield done()
                    key, day, n, digest = (dataset, month), on, before, _Sha256(packed.as_py() if kind < 0 else None)
                if kind > 0:
                    digest.update((b"\n\n" if n else b"") + (f"## {on}\n\n".encode() if on != day else b""))
                    day, n = on, n + 1
                if kind >= 0:
                    digest.update(_unpacked(packed))
        if key:
            yield done()

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["dataset_id"], b["month"], b["messages"], pa.array([_Sha256(x).hexdigest() for x in b["state"].to_pylist()], pa.string())], names=["dataset_id", "month", "messages", "sha256"])

    states = None
    for a, z in rounds:
        lines = _month_lines(ev.where(F.unix_date(F.to_date("ts")).between(a, z))).select("dataset_id", _month().alias("month"), F.lit(1).alias("kind"), "ts", "id", _day().alias("day"), F.lit(0).cast("long").alias("messages"), "packed")
        fronts = days.where(F.col("_on").between(a, z)).select(*key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("messages"), _packed("_front").alias("packed"))
        rows = lines.unionByName(fronts, allowMissingColumns=True)
        if states:
            rows = rows.unionByName(states.select(*key, F.lit(-1).alias("kind"), "day", "messages", F.col("state").alias("packed")), allowMissingColumns=True)
        rows = rows.repartition(*key).sortWithinPartitions(*key, "kind", "ts", "id").select(*key, "kind", "day", "messages", "packed")
        spent, states = states, materialize(rows.mapInArrow(taken, "dataset_id string, month string, messages long, day string, state binary"), "digest-states")
        if spent:
            discard(spent)
    return states.mapInArrow(ended, "dataset_id string, month string, messages long, sha256 string")


def month_digests(ev: DataFrame, size: int = ROUND) -> DataFrame:
    """The SHA-256 of each month's page and its messages, of months of any length: dataset_id, month, messages, sha256.

    A digest is taken from a text's first byte to its last, so a month is one
    task; its packed messages pass through it in order, one at a time. More
    than ``size`` messages are taken in rounds of whole days, each of which
    reads its days' events, so that disk holds the texts of one round.
    """
    rounds = _rounds(ev, size) if _crypto() else []
    if len(rounds) > 1:
        return _digests_in_rounds(ev, rounds)
    # The front matter is a row before a month's messages: a join before the shuffle could have its skewed keys split by Spark.
    lines = _month_lines(ev).select("dataset_id", _month().alias("month"), F.lit(1).alias("kind"), "ts", "id", _day().alias("day"), "packed")
    fronts = _days(ev).select(F.col("_d").alias("dataset_id"), F.col("_m").alias("month"), F.lit(0).alias("kind"), "_front").distinct().select("*", _packed("_front").alias("packed")).drop("_front")
    key = ["dataset_id", "month"]
    rows = lines.unionByName(fronts, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "kind", "ts", "id").select(*key, "kind", "day", "packed")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda: pa.RecordBatch.from_pydict({"dataset_id": [key[0]], "month": [key[1]], "messages": [n], "sha256": [digest.hexdigest()]})
        key, day, n, digest = None, None, 0, hashlib.sha256()
        for b in batches:
            for dataset, month, kind, on, packed in zip(*(b[c].to_pylist() for c in ("dataset_id", "month", "kind", "day")), b["packed"]):
                if kind == 0:
                    if key:
                        yield done()
                    key, day, n, digest = (dataset, month), None, 0, hashlib.sha256()
                else:
                    digest.update((b"\n\n" if n else b"") + (f"## {on}\n\n".encode() if on != day else b""))
                    day, n = on, n + 1
                digest.update(_unpacked(packed))
        if key:
            yield done()

    return rows.mapInArrow(taken, "dataset_id string, month string, messages long, sha256 string")


def month_pages(ev: DataFrame) -> DataFrame:
    """One Markdown text for each dataset and month: its parts joined. For months that fit a cell; exports keep the parts, and ``month_digests`` takes any month."""
    months = month_parts(ev).groupBy("dataset_id", "month").agg(F.sum("messages").alias("messages"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("l"))
    return months.select("dataset_id", "month", "messages", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))


def month_index(ev: DataFrame) -> DataFrame:
    rows = ev.groupBy("dataset_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    item = F.concat(F.lit("- [["), "month", F.lit("]] "), F.col("n").cast("string"))
    return rows.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("month", item.alias("item")))).alias("l")).select("dataset_id", F.concat(F.lit("# Index\n\n"), F.array_join(F.transform("l", lambda x: x["item"]), "\n")).alias("text"))


def export_markdown(ev: DataFrame, path: str) -> None:
    """Months in files by part, part=0 first, and each dataset's index."""
    month_parts(ev).select("dataset_id", "month", "part", "text").write.partitionBy("dataset_id", "month", "part").text(f"{path}/months")
    month_index(ev).write.partitionBy("dataset_id").text(f"{path}/index")


def case_report(ev: DataFrame, latest: int = 200, top: int = 10, **thresholds) -> dict[str, DataFrame]:
    """Key figures, worst anomalies, participants and latest events."""
    found = relations.anomalies(ev, **thresholds)
    kpi = volume.volume_summary(ev).join(volume.activity_summary(ev).select("dataset_id", "active_days"), "dataset_id").join(relations.anomaly_counts(found), "dataset_id", "left")
    return {
        "kpis": kpi.select("dataset_id", "messages", "words", "active_days", F.coalesce("critical", F.lit(0)).cast("long").alias("critical")),
        "anomalies": top_k_per(found, ["dataset_id"], top, [F.desc("weight"), F.desc("ts"), F.asc("type"), F.asc("detail")]),
        "participants": volume.by_person(ev),
        "latest": volume.head_per_dataset(ev, latest, newest=True),
    }


#: Children of a node of the digest tree, and its levels: 1024**4 events a dataset.
RUN, LEVELS = 1024, 4


def run_digests(ev: DataFrame) -> DataFrame:
    """The digests of each dataset's runs of RUN events in order: dataset_id, run (from 0), h."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    row = F.sha2(F.concat_ws("|", F.col("id").cast("string"), ms, "content"), 256)
    numbered = with_number(ev.select("dataset_id", "ts", "id", row.alias("h")))
    return _parents(numbered.select("dataset_id", (F.col("n") - 1).alias("run"), "h"))


def _parents(nodes: DataFrame) -> DataFrame:
    up = nodes.groupBy("dataset_id", F.floor(F.col("run") / RUN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("run", "h"))).alias("l"))
    return up.select("dataset_id", F.col("up").alias("run"), F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256).alias("h"))


def content_digest(ev: DataFrame) -> DataFrame:
    """A digest of each dataset's events in order: the root of a tree of LEVELS levels, whose nodes have RUN children at most."""
    nodes = run_digests(ev)
    for _ in range(LEVELS - 1):
        nodes = _parents(nodes)
    return nodes.select("dataset_id", F.col("h").alias("sha256"))


def damaged_runs(kept: DataFrame, ev: DataFrame) -> DataFrame:
    """Runs whose digests (``kept``, as run_digests gave them) aren't those of the events now: dataset_id, run, first_n and last_n."""
    now = run_digests(ev).select(F.col("dataset_id").alias("_d"), F.col("run").alias("_r"), F.col("h").alias("_h"))
    met = kept.join(now, (F.col("dataset_id") == F.col("_d")) & (F.col("run") == F.col("_r")), "full").where(~F.col("h").eqNullSafe(F.col("_h")))
    run = F.coalesce("run", "_r")
    return met.select(F.coalesce("dataset_id", "_d").alias("dataset_id"), run.alias("run"), (run * RUN + 1).alias("first_n"), ((run + 1) * RUN).alias("last_n"))


def integrity_manifest(source: DataFrame, exported: DataFrame) -> DataFrame:
    """Expected and exported counts, missing rows, repeated identifiers, times that run back in ``position`` order, ends, digest and verdict."""
    ends = lambda df, s: volume.first_last(df).select("dataset_id", *[F.col(c).alias(f"{c}_{s}") for c in ("first_id", "last_id")])
    want = source.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("expected"))
    got = exported.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("actual"), F.countDistinct("id").alias("ids"))
    lost = source.join(exported.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("missing"))
    if "position" in exported.columns:
        lag = with_previous(exported.select("dataset_id", F.col("ts").alias("at"), F.timestamp_seconds("position").alias("ts"), "id"), ["at"])
        back = lag.where(F.col("at") < F.col("prev_at")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("regressions"))
    else:
        back = want.select("dataset_id", F.lit(0).cast("long").alias("regressions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    m = want.join(got, "dataset_id", "left").join(lost, "dataset_id", "left").join(back, "dataset_id", "left").join(ends(source, "want"), "dataset_id").join(ends(exported, "got"), "dataset_id", "left").join(content_digest(exported), "dataset_id", "left")
    m = m.select("dataset_id", "expected", zero("actual").alias("actual"), zero("missing").alias("missing"), (zero("actual") - zero("ids")).alias("duplicates"), zero("regressions").alias("regressions"),
                 (F.col("first_id_want").eqNullSafe(F.col("first_id_got")) & F.col("last_id_want").eqNullSafe(F.col("last_id_got"))).alias("ends_match"), "sha256")
    bad = F.array_join(F.filter(F.array(F.when(F.col("missing") > 0, F.concat(F.lit("missing "), F.col("missing").cast("string"))), F.when(F.col("duplicates") > 0, F.concat(F.lit("duplicates "), F.col("duplicates").cast("string"))),
                                        F.when(F.col("regressions") > 0, F.concat(F.lit("regressions "), F.col("regressions").cast("string"))), F.when(~F.col("ends_match"), F.lit("ends differ")), F.when(F.col("expected") != F.col("actual"), F.lit("counts differ"))), lambda x: x.isNotNull()), "; ")
    return m.withColumn("diagnostics", bad).withColumn("status", F.when(F.col("diagnostics") == "", F.lit("VERIFIED")).otherwise(F.lit("FAILED")))


def analyze(ev: DataFrame) -> dict[str, DataFrame]:
    """All reports over one written minimum of the events."""
    ev = materialize(ev.select("id", "dataset_id", "actor", "ts", "event_type", "content"), "analyzed")
    reports = {
        "volume": volume.volume_summary(ev), "by_person": volume.by_person(ev), "by_hour": volume.by_hour(ev), "by_weekday": volume.by_weekday(ev), "by_date": volume.by_date(ev),
        "peaks": volume.peaks(ev), "activity": volume.activity_summary(ev), "streak": volume.longest_streak(ev), "gap": volume.longest_gap(ev), "responses": volume.response_times(ev),
        "top_emojis": words.top_emojis(ev), "emoji_by_person": words.emoji_by_person(ev), "emoji_over_time": words.emoji_over_time(ev), "words": words.word_summary(ev), "top_words": words.top_words(ev),
        "top_phrases": words.top_phrases(ev), "top_urls": words.top_urls(ev), "top_domains": words.top_domains(ev), "top_mentions": words.top_mentions(ev), "relationships": relations.relationships(ev),
        "threads": relations.threads(ev), "anomalies": relations.anomalies(ev), "topics": topics.topic_report(topics.assign_topics(ev)), "insights": topics.insights(ev),
    }
    return reports


def persist_report(df: DataFrame, path: str) -> DataFrame:
    """Saves a report and reads it back, so that it can be used again in other sessions."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
