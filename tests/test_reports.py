"""Reports on literal events, and invariants over the event table of the queries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import documents, relations, search, sequence, topics, volume, words
from tidewell.sources import sinks

T0 = dt.datetime(2024, 1, 10, 12)


def events(spark, data):
    rows = [(str(i), "d", a, t, "message", c) for i, (a, t, c) in enumerate(data)]
    return spark.createDataFrame(rows, "id string, dataset_id string, actor string, ts timestamp_ntz, event_type string, content string")


def at(day=0, hour=0, minute=0, sec=0):
    return T0 + dt.timedelta(days=day, hours=hour, minutes=minute, seconds=sec)


def test_volume(spark):
    ev = events(spark, [("Ann", at(), "short"), (" Ann ", at(minute=1), "x" * 75), ("", at(1), "last one here")])
    (v,) = volume.volume_summary(ev).collect()
    assert (v.messages, v.words, v.chars, v.span_days) == (3, 5, 93, 1)
    assert {r.actor: (r.messages, r.percentage) for r in volume.by_person(ev).collect()} == {"Ann": (2, 66.7), "Unknown": (1, 33.3)}
    assert volume.longest_messages(ev, 1).first().chars == 75
    assert volume.by_hour(ev).count() == 24 and volume.by_weekday(ev).agg(F.sum("messages")).first()[0] == 3


def test_emojis(spark):
    ev = events(spark, [("a", at(), "hi 😂😂 🎉"), ("b", at(minute=1), "😂 👍")])
    (s,) = words.emoji_summary(ev).collect()
    assert (s.total, s.distinct_emojis) == (5, 3)
    top = words.top_emojis(ev).orderBy("rank").first()
    assert (top.emoji, top.n, top.percentage) == ("😂", 3, 60.0)
    assert {r.actor: r.total for r in words.emoji_by_person(ev).collect()} == {"a": 3, "b": 2}


def test_activity(spark):
    ev = events(spark, [("a", at(), "x"), ("b", at(minute=1), "y"), ("a", at(1), "z"), ("a", at(5), "w")])
    assert volume.longest_streak(ev).first().days == 2 and volume.longest_gap(ev).first().days == 4 and volume.activity_summary(ev).first().active_days == 3
    assert volume.response_times(ev).where("actor = 'b'").first().avg_secs == 60


def test_upper_median(spark):
    ev = events(spark, [(a, at(sec=s), "x") for a, s in (("a", 0), ("b", 10), ("a", 20), ("b", 50), ("a", 60), ("b", 110), ("a", 115), ("b", 215))])
    r = volume.response_times(ev).where("actor = 'b'").first()
    assert (r.samples, r.median_secs) == (4, 50)  # of 10, 30, 50, 100


def test_text(spark):
    ev = events(spark, [("a", at(), "Look https://www.example.com/a?x=1 great idea @Bob"), ("b", at(minute=1), "great idea www.example.com 1234")])
    assert words.top_domains(ev).first().asDict() == {"dataset_id": "d", "domain": "example.com", "n": 2, "rank": 1}
    assert words.top_mentions(ev).first().mention == "bob"
    assert ("great idea", 2) in [(r.phrase, r.n) for r in words.top_phrases(ev).collect()]
    assert words.top_words(ev).where("word in ('1234', 'www')").count() == 0


def test_anomalies(spark):
    night = events(spark, [("a", at(hour=14, sec=30 * i), "x") for i in range(30)])
    assert relations.late_night_surges(night).first().actor == "a"
    burst = events(spark, [("a", at(hour=2, sec=5 * i), "x") for i in range(35)])
    assert relations.velocity_bursts(burst).first().metric == 35
    assert relations.greedy_bursts(burst).first().messages == 25
    quiet = events(spark, [*(("a", at(minute=5 * i), "x") for i in range(4)), ("b", at(45), "y")])
    assert relations.dormancy_gaps(quiet).first().metric >= 44
    urgent = events(spark, [("a", at(minute=i), "x") for i in range(4)] + [("b", at(minute=9), "URGENT wire the bank password")])
    assert relations.urgency_spikes(urgent).first().severity == "CRITICAL"
    assert relations.anomalies(urgent).count() == 1 and relations.anomalies(events(spark, [("a", at(), "urgent asap help")])).count() == 0
    ghost = events(spark, [("g", at(minute=i), "x") for i in range(30)] + [("a", at(40), "y")])
    assert relations.ghost_participants(ghost).first().actor == "g"


def test_windows_cross_midnight(spark):
    ev = events(spark, [("a", dt.datetime(2024, 1, 1, 23, 58) + dt.timedelta(seconds=10 * i), "x") for i in range(30)])
    assert relations.velocity_bursts(ev, 25).first().metric == 30 and relations.threads(ev).first().messages == 30


def test_threads_and_topics(spark):
    ev = events(spark, [("a" if i % 2 else "b", at(minute=i), "invoice payment" if i == 0 else "deploy the server code") for i in range(4)] + [("c", at(hour=3, sec=30 * i), "lol") for i in range(3)])
    assert [r.messages for r in relations.threads(ev).orderBy("rank").collect()] == [4, 3]
    report = {r.topic: r.messages for r in topics.topic_report(topics.assign_topics(ev)).collect()}
    assert report == {"financial": 1, "technical": 3, "social": 3}


def test_insights(spark):
    ev = events(spark, [("a", at(hour=11, minute=30), "😂"), ("a", at(hour=13), "x"), ("b", at(hour=21), "y")])
    found = {r.title: r.summary for r in topics.insights(ev).collect()}
    assert "66.7%" in found["Primary Contributor"] and "Favorite Emoji" in found and "Night Owl Tendency" in found


def test_relationships(spark):
    ev = events(spark, [("a", at(), "1"), ("b", at(minute=1), "2"), ("a", at(minute=3), "3"), ("b", at(hour=8), "4")])
    (r,) = relations.relationships(ev).collect()
    assert (r.exchanges, r.a_replies, r.b_replies, r.b_initiations, r.avg_secs_a_to_b, r.avg_secs_b_to_a, r.balance) == (3, 1, 1, 1, 60, 120, 0.33)


def test_search(spark):
    ev = events(spark, [("Ann", at(), "the <quarterly> report is ready"), ("Bob", at(minute=1), "lunch tomorrow?")])
    (hit,) = search.search(ev, "report").collect()
    assert hit.actor == "Ann" and hit.score > 1 and "<mark>report</mark>" in hit.snippet and "&lt;quarterly&gt;" in hit.snippet
    a, b, c = (search.embedding(t) for t in ("database connection error", "error in the database connection", "birthday party photos"))
    near, far = (max(0, min(1, (sum(x * y for x, y in zip(a, v)) + 1) / 2)) for v in (b, c))
    assert len(a) == 384 and near > 0.6 and near > far
    assert search.search(ev, "report", mode="semantic").first().actor == "Ann"
    assert search.fnv1a("", 0) == 0x811C9DC5 - (1 << 32)


def test_integrity(spark):
    ev = events(spark, [("a", at(minute=i), f"m{i}") for i in range(5)])
    assert sinks.integrity_manifest(ev, ev).first().status == "VERIFIED"
    lost = sinks.integrity_manifest(ev, ev.where("id = 0")).first()
    assert (lost.status, lost.missing) == ("FAILED", 4)
    twice = sinks.integrity_manifest(ev, ev.union(ev.where("id = 3"))).first()
    assert (twice.status, twice.duplicates) == ("FAILED", 1)
    back = ev.withColumn("position", F.when(F.col("id") == 2, 0).otherwise(F.col("id").cast("int") + 1))
    assert sinks.integrity_manifest(ev, back).first().regressions == 1


def test_json_export_is_packed(spark, tmp_path):
    ev = events(spark, [("a", at(minute=i), f'say "{i}",\nthen') for i in range(4)])
    sinks.export_json(ev, f"{tmp_path}/json")
    files = [f.name for f in tmp_path.glob("json/events/part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert [r.content for r in spark.read.json(f"{tmp_path}/json/events").orderBy("id").collect()] == [r.content for r in ev.orderBy("id").collect()]


def test_event_table_is_packed(spark, tmp_path):
    ev = events(spark, [("a", at(minute=i), f'say "{i}",\nthen') for i in range(4)])
    sinks.write_events(ev, f"{tmp_path}/ev")
    files = [f.name for f in tmp_path.glob("ev/*/*.parquet")]
    assert files and all(".zstd." in f for f in files)


def test_csv_export_is_packed(spark, tmp_path):
    ev = events(spark, [("a", at(minute=i), f'say "{i}",\nthen') for i in range(4)])
    sinks.export_csv(ev, f"{tmp_path}/csv")
    files = [f.name for f in tmp_path.glob("csv/part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv")
    assert sorted(r.content for r in back.collect()) == sorted(r.content for r in ev.collect())


def test_csv_export_keeps_every_sign(spark, tmp_path):
    texts = [" see you", "see you ", "\n\nlead", "\ttab", "a\r\n", "\r\nb", "a\rb\r", 'nul\0"', "\0", "\x01 x", '"', '","', "\\", "#c", "null", None, "\x85x"]
    rows = [(i, at(minute=i), " who " if i % 2 else None, "message", t) for i, t in enumerate(texts)]
    ev = spark.createDataFrame(rows, "id long, ts timestamp_ntz, actor string, event_type string, content string")
    sinks.export_csv(ev, f"{tmp_path}/csv")
    got = {int(r.id): (r.actor, r.content) for r in sinks.read_csv(spark, f"{tmp_path}/csv").collect()}
    assert got == {i: (actor, t) for i, _, actor, _, t in rows}


def test_exports(spark, tmp_path):
    ev = events(spark, [("a", at(minute=i), f'say "{i}",\nthen') for i in range(4)])
    sinks.export_csv(ev, f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv").where("content like 'say \"2\"%then'").count() == 1
    sinks.export_json(ev, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/events").count() == 4 and spark.read.json(f"{tmp_path}/json/datasets").first().events == 4
    sinks.export_markdown(ev, f"{tmp_path}/md")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md/months/dataset_id=d/month=2024-01").collect())
    assert "messages: 4" in text and "## 2024-01-10" in text
    sinks.write_events(ev, f"{tmp_path}/ev")
    sinks.write_events(ev.withColumn("dataset_id", F.lit("e")), f"{tmp_path}/ev")
    sinks.drop_dataset(spark, f"{tmp_path}/ev", "d")
    assert {r.dataset_id for r in sinks.read_events(spark, f"{tmp_path}/ev").collect()} == {"e"}
    assert sinks.persist_report(volume.by_date(ev), f"{tmp_path}/rep").count() == 1


def test_analyze_runs_all_reports(spark):
    ev = events(spark, [("a" if i % 2 else "b", at(minute=i), "hello 😂 world") for i in range(8)])
    assert all(df.collect() is not None for df in sinks.analyze(ev).values())


@pytest.fixture(scope="module")
def ev(spark):
    from tidewell.plans.testbed import testbed

    return testbed(spark, "/root/testdata/sf0.001").persist()


def test_invariants(ev):
    n = ev.count()
    total = lambda df, c="messages": df.agg(F.sum(c)).first()[0]
    assert total(volume.by_hour(ev)) == total(volume.by_weekday(ev)) == total(volume.by_date(ev)) == total(volume.timeline(ev, "week")) == n
    emoji = total(words.emoji_summary(ev), "total")
    assert emoji == total(words.emoji_over_time(ev), "total") == words.emojis(ev).count()
    for r in volume.by_person(ev).groupBy("dataset_id").agg(F.sum("percentage").alias("p")).collect():
        assert abs(r.p - 100) < 1
    every = relations.threads(ev, min_messages=1, limit=None)
    assert total(every) == n


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert entry.entry(spark).columns == ["dataset_id", "actor", "avg_secs", "median_secs", "samples"]


def test_event_view_has_all_events_and_whole_texts(spark, tmp_path):
    import duckdb

    from tidewell.plans.testbed import WITH_EV, testbed

    texts = ["a" * 700 + " end", None, "b", "twice", "twice", "no id"]
    docs = list(zip([70, -3, 5_000_000_000, 12, 12, None], texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = [(i, i, ("click", "signup", "view")[i % 3], T0 + dt.timedelta(days=i)) for i in range(-2, 40)]
    spark.createDataFrame(made, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.content for r in testbed(spark, str(tmp_path)).collect()}
    by_number = ["", "twice", "twice", texts[0], "b", "no id"]
    assert set(got) == {i for i, *_ in made}
    assert all(c.startswith(by_number[i % 6]) and c[len(by_number[i % 6])] == " " for i, c in got.items())
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert dict(con.execute(WITH_EV + "z AS (SELECT 1) SELECT id, content FROM ev").fetchall()) == got
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame(made, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/e/events.parquet")
    assert testbed(spark, f"{tmp_path}/e").count() == len(made)


def test_bursts_and_numbers_are_not_one_task(spark):
    import random

    from tidewell.operators.normalize import normalize

    r, t, times = random.Random(4), 0, []
    for _ in range(600):
        t += r.choice([1, 20, 60, 299, 300, 301, 4000])
        times.append(t)
    ev = events(spark, [("a", at(sec=s), "x") for s in times])
    want, a, z = [], 0, 0
    while z < len(times):
        while times[z] - times[a] > 300:
            a += 1
        if z - a + 1 >= 4:
            want.append((at(sec=times[a]), at(sec=times[z]), z - a + 1))
            a = min(a + 10, z)
        z += 1
    got = relations.greedy_bursts(ev, 4)
    assert sorted((x.start_ts, x.end_ts, x.messages) for x in got.collect()) == sorted(want) and len(want) > 20
    assert "block" in got._jdf.queryExecution().analyzed().toString()

    lines = [(f, n, "a", at(), "2024", c, "message", False, None) for f in ("t", None) for n, c in [(None, "first"), (3, "x"), (5, None), (70_000, "y"), (65_536, "z"), (9_000_000, "last")]]
    records = spark.createDataFrame(lines, "source_file string, line_no long, actor string, ts timestamp, raw_timestamp string, content string, event_type string, has_media boolean, metadata string")
    out, _ = normalize(records, "d")
    for f in ("t", None):
        assert [(x.content, x.sequence_num) for x in sorted((x for x in out.collect() if x.source_file == f), key=lambda x: x.sequence_num)] == [("first", 1), ("x", 2), ("z", 3), ("y", 4), ("last", 5)]
    assert "_range" in out._jdf.queryExecution().analyzed().toString()


def test_similarity_at_shares_that_floats_round(spark):
    docs = spark.createDataFrame([(0, " ".join(f"a{i:03d}" for i in range(100))), (1, " ".join(f"a{i:03d}" for i in range(93, 100)))], "doc_id long, text string")
    for least, found in ((6, 1), (7, 1), (8, 0)):
        assert documents.document_similarity(docs, min_percent=least).count() == found


def test_similarity_equals_all_pairs(spark):
    r = random.Random(12)
    texts = [" ".join(sorted({f"w{r.randrange(30)}x" for _ in range(r.randrange(1, 14))})) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    for least in (1, 14, 28, 55, 56, 90):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and sets[i] & sets[j]}
        assert {(x.a, x.b) for x in documents.document_similarity(docs, min_percent=least).collect()} == want


def test_embeddings_of_a_batch_equal_those_of_single_texts():
    texts = ["Database connection error", "", None, "a bb ccc dddd dddd dddd", "naïve façade 漢字 𝒳𝒴𝒵𝒳𝒴 ok", "x" * 400]
    for _ in range(2):  # the second time from kept places
        for got, text in zip(search.embeddings(texts), texts):
            assert max(abs(a - b) for a, b in zip(got, search.embedding(text))) < 1e-12


def test_similarity_in_one_step_equals_that_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD_TEXTS", 2)
    texts = ["Database connection error", "", None, "a bb ccc dddd dddd", "naïve façade 漢字 𝒳𝒴𝒵𝒳𝒴 ok", "Database connection error", "x" * 400] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    query = F.array(*[F.lit(x) for x in search.embedding("error connection")])
    found = df.select("id", search.similarity(F.col("t"), "error connection").alias("s"), search.cosine01(search.embed("t"), query).alias("c"), search.embed("t").alias("v"))
    rows = found.orderBy("id").collect()
    assert [r.s for r in rows] == [r.c for r in rows] and all(max(abs(a - b) for a, b in zip(r.v, search.embedding(texts[r.id]))) < 1e-7 for r in rows)
    # A search's vectors stay in Python.
    ev = df.select(F.col("id").cast("string").alias("id"), F.lit("d").alias("dataset_id"), F.current_timestamp().alias("ts"), F.col("t").alias("content"))
    assert "zip_with" not in _optimized(search.search(ev, "error", mode="semantic"))


def test_terms_hold_one_text_of_a_batch_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from tidewell.functions.terms import numbers_of

    texts = pa.array([f"{i} urgent 😂 " + "x" * 100_000 for i in range(40)] + [None, "", "0 urgent"])
    tracemalloc.start()
    found = numbers_of(texts, ("help", "urgent")).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [[1]] * 40 + [[], [], [1]] and peak < 4_000_000  # all strings would be 16 MB


def test_trailing_count_over_days(spark):
    base = dt.datetime(2024, 1, 1, 12)
    ev = spark.createDataFrame([(i, "d", base + dt.timedelta(hours=20 * i)) for i in range(8)], "id long, dataset_id string, ts timestamp")
    got = {x.id: x.recent for x in sequence.trailing_count(ev, 3 * 86_400).collect()}
    assert got == {i: sum(0 <= (i - j) * 20 <= 72 for j in range(i + 1)) for i in range(8)}


def _scan_bursts(times, least, window, restart):
    """The window's events one by one."""
    out, a = [], 0
    for z in range(len(times)):
        while times[z] - times[a] > window:
            a += 1
        if z - a + 1 >= least:
            out.append((times[a], times[z], z - a + 1))
            a = min(a + restart, z)
    return out


@pytest.mark.parametrize(("least", "restart", "block"), [(4, 10, 7), (25, 10, 40), (5, 2, 16), (3, 1, 64), (6, 6, 1000)])
def test_greedy_bursts_equal_a_scan_over_blocks(spark, least, restart, block):
    import random
    from datetime import datetime, timedelta

    r, base = random.Random(least), datetime(2024, 1, 1)
    data, want = [], []
    for name, gaps in {"steady": [7] * 900, "mixed": [r.choice([1, 5, 20, 90, 400]) for _ in range(900)], "bursty": [1 if i % 100 < 60 else 300 for i in range(700)], "same": [0] * 200, "few": [1]}.items():
        t, times = 0, []
        for g in gaps:
            t += g
            times.append(t)
        data += [(i, name, "a", base + timedelta(seconds=s)) for i, s in enumerate(times)]
        want += [(name, base + timedelta(seconds=a), base + timedelta(seconds=z), n) for a, z, n in _scan_bursts(times, least, 300, restart)]
    ev = spark.createDataFrame(data, "id long, dataset_id string, actor string, ts timestamp").repartition(4)
    assert sorted(map(tuple, relations.greedy_bursts(ev, least, 300, restart, block).collect())) == sorted(want)


def test_order_statistics_equal_sorting(spark):
    import random

    from tidewell.operators.sequence import order_statistic

    r = random.Random(4)
    rows = [(g, r.randrange(1 << 12) if g else 5) for g in (0, 1, 2, None) for _ in range(301 if g else 40)] + [(7, 0), (8, 4095), (8, 4095)]
    got = order_statistic(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", F.floor(F.col("n") / 2) + 1, 12).collect()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert {x.g: (x.n, x.v) for x in got} == {g: (len(v), sorted(v)[len(v) // 2]) for g, v in by.items()}


@pytest.mark.parametrize("tracked", [64, 100_000])
def test_top_values_equal_full_counts(spark, tracked):
    from collections import Counter

    from tidewell.operators.heavy import top_values

    r = random.Random(2)
    rows = [("skewed", f"v{int(r.paretovariate(0.9))}") for _ in range(6000)] + [("flat", f"v{r.randrange(900)}") for _ in range(3000)] + [("few", "a"), ("few", None), (None, "n"), (None, "n"), (None, "m")]
    got = top_values(spark.createDataFrame(rows, "g string, v string").repartition(5), ["g"], "v", 10, tracked=tracked).collect()
    want = []
    for g in {g for g, _ in rows}:
        c = Counter(v for x, v in rows if x == g and v is not None)
        want += [(g, v, n, k) for k, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10], 1)]
    assert sorted(((x.g, x.v, x.n, x["rank"]) for x in got), key=str) == sorted(want, key=str)


def test_term_numbers_are_those_of_searches(spark):
    import re

    from tidewell.functions.terms import numbers_in, term_names, term_numbers

    terms = ["he", "she", "hers", "urgent", "now", "a b", "", "hers", "né"]
    texts = ["ushers", "She is URGENT now", "a  b a b", "", None, "hé-né", "nown now", "😂she😂"]
    for whole in (False, True):
        for t in texts:
            want = [] if t is None else [i for i, w in enumerate(terms) if (re.search(rf"(?<!\w){re.escape(w)}(?!\w)", t.lower()) if whole and w else w in t.lower())]
            assert numbers_in(None if t is None else t.lower(), tuple(terms), whole) == want, (t, whole)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", term_names(term_numbers(F.col("t"), terms), terms).alias("w")).collect()
    assert all(x.w == ([] if x.t is None else [w for w in terms if w in x.t.lower()]) for x in rows)


def test_month_parts_and_the_digest_tree(spark):
    ev = events(spark, [("Ann", at(day=k // 40, sec=k), f"m{k}\nmore") for k in range(200)])
    whole = {(r.dataset_id, r.month): r.text for r in sinks.month_pages(ev).collect()}
    for size in (1, 7, 1000):
        parts = sinks.month_parts(ev, size).orderBy("dataset_id", "month", "part").collect()
        joined = {}
        for p in parts:
            joined.setdefault((p.dataset_id, p.month), []).append(p.text)
        assert {k: "\n\n".join(v) for k, v in joined.items()} == whole and max(p.messages for p in parts) <= size
    big = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("dataset_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.lit("x").alias("content"))
    kept = sinks.run_digests(big)
    bad = big.withColumn("content", F.when(F.col("id") == "1500", "y").otherwise(F.col("content")))
    assert [tuple(r) for r in sinks.damaged_runs(kept, bad).collect()] == [("d", 1, 1025, 2048)] and sinks.damaged_runs(kept, big).collect() == []
    assert sinks.content_digest(bad).first() != sinks.content_digest(big).first()


def test_months_of_equal_times_and_their_digests(spark):
    import hashlib

    made = [(str(k % 3 if k < 60 else k), "d", at(day=k // 45, sec=k // 30), f"m{k // 30}é\n\nz" if k % 50 else None) for k in range(120)] + [("x", None, at(), "y"), ("x", "d", None, "y")]
    ev = spark.createDataFrame(made, "id string, dataset_id string, ts timestamp, content string").withColumn("actor", F.when(F.col("id") != "1", "Ann")).repartition(3)
    found = {r.month: (r.messages, r.sha256) for r in sinks.month_digests(ev).collect()}
    for size in (1, 7, 20, 1000):
        parts = sinks.month_parts(ev, size).orderBy("month", "part").collect()
        assert [p.part for p in parts] == list(range(len(parts))) and all(p.messages == min(size, 120 - p.part * size) for p in parts)
        text = "\n\n".join(p.text for p in parts)
        assert text.count("## 20") == 3 and text.count("---\n") == 2
    steady = ev.where("id > '1' and id is not null or actor is null").dropDuplicates(["dataset_id", "ts", "id"])
    tuned = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    digests = sinks.month_digests(steady).collect()
    for k in tuned:
        spark.conf.unset(k)
    assert len(digests) == 1
    for r in digests:
        text = "\n\n".join(p.text for p in sinks.month_parts(steady, 7).orderBy("part").collect())
        assert r.sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {m: n for m, (n, _) in found.items()} == {parts[0].month: 120}


def test_texts_of_months_are_shuffled_once_and_packed(spark):
    ev = events(spark, [("Ann", at(sec=k), f"m{k}") for k in range(9)])
    for made in (sinks.month_parts(ev, 2), sinks.month_digests(ev)):
        assert "collect_list(struct(at" not in _optimized(made) and "_packed" in _optimized(made)


def test_similar_documents_with_copies_and_a_hot_token(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = [" ".join(r.sample(vocabulary, r.randrange(1, 25))) for _ in range(120)] + ["hot only"] * 40 + [f"hot alone{i % 9}" for i in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t}
    from tidewell.constants import STOP_WORDS

    sets = {i: {w for w in s if len(w) >= 3 and w not in STOP_WORDS} for i, s in sets.items()}
    monkeypatch.setattr(documents, "HOT_ROWS", 3)
    for least in (1, 40, 50, 75, 100):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = documents.document_similarity(docs, min_percent=least).collect()
        assert {(x.a, x.b) for x in got} == want and len(got) == len(want), least
        assert all(x.percent == int(100 * len(sets[x.a] & sets[x.b]) / len(sets[x.a] | sets[x.b]) + 0.5) for x in got)


def test_similar_documents_by_blocks_and_tiles(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.sample([f"word{i}" for i in range(80)], r.randrange(1, 60))) for _ in range(150)]
    sets = [set(t.split()) for t in texts]
    monkeypatch.setattr(documents, "BLOCK_NODES", (4, 16))
    monkeypatch.setattr(documents, "TILE", 3)
    monkeypatch.setattr(documents, "TILE_BYTES", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (20, 50):
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = [(x.a, x.b) for x in documents.document_similarity(docs, min_percent=least).collect()]
        assert set(got) == want and len(got) == len(want), least
    # No pair carries the sets' sketches: they are sent by blocks of nodes.
    toks = documents._classes(docs, "doc_id")[2]
    found = documents._near_by_blocks(toks, 50)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(x.a, x.b) for x in found.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_all_pairs_that_share_a_token_by_counts(spark, monkeypatch, tmp_path):
    from tidewell.plans import tables

    r = random.Random(8)
    texts = [" ".join(r.sample([f"word{i}" for i in range(90)], r.randrange(1, 30))) for _ in range(90)] + ["hot only"] * 9 + ["alone"] * 2 + [None, "", "single"]
    sets = {i: set(t.split()) - {"only"} for i, t in enumerate(texts) if t}
    for name, value in {"BLOCK_NODES": (4, 16), "COPIES": 4, "MATCHES": 50, "PAIRS": 7}.items():
        monkeypatch.setattr(documents, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((a, b, int(100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) + 0.5)) for a in sets for b in sets if a < b and sets[a] & sets[b])
    assert sorted(map(tuple, tables.QUERIES["document_similarity"](spark, str(tmp_path)).collect())) == want
    assert any(percent < 50 for _, _, percent in want) and "s >= 50" not in tables.ORACLES["document_similarity"]


def test_the_most_similar_pair_is_found_without_all_pairs(spark, monkeypatch):
    asked, nodes = [], documents._similar_nodes
    monkeypatch.setattr(documents, "_similar_nodes", lambda toks, p: (asked.append(p), nodes(toks, p))[1])
    base = [f"word{i}" for i in range(20)]
    cases = {(99,): ["zz1 other", " ".join(base), " ".join(base[::-1]), "zz1 other"], (99, 90): [" ".join(base), " ".join(base[:19]), "zz1 other"]}
    for steps, texts in cases.items():
        asked.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = documents.most_similar_documents(docs, min_percent=50).collect()
        assert asked == list(steps), texts
        assert got == documents.most_similar(documents.document_similarity(docs, min_percent=50)).collect()


def test_newest_events_are_picked_without_texts(spark):
    rows = [("d", str(i // 2), at(sec=i // 4), f"t{i}") for i in range(20)] + [(None, None, None, "n"), ("e", "1", None, "z")]
    ev = spark.createDataFrame(rows, "dataset_id string, id string, ts timestamp_ntz, content string")
    for n, newest in ((3, True), (5, False), (100, True)):
        got = volume.head_per_dataset(ev, n, newest)
        want = sequence.top_k_per(ev, ["dataset_id"], n, [F.desc("ts"), F.desc("id")] if newest else [F.asc("ts"), F.asc("id")])
        cells = lambda df: sorted((str(r.dataset_id), r["rank"], str(r.id), str(r.ts)) for r in df.collect())
        assert cells(got) == cells(want) and "LeftSemi" in _optimized(got)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_media_are_classified_once(spark):
    from tidewell.functions.text import classify_media

    ev = spark.createDataFrame([("see VID-1.mp4 (file attached)",), ("a <image omitted>",), ("AUD-x y.opus",), ("c.docx ( file attached )",), (None,)], "content string")
    found = ev.select(classify_media(F.col("content"), F.lit(False)).alias("m")).select("m.*")
    assert [tuple(r) for r in found.collect()] == [(True, "video", "VID-1.mp4"), (True, "image", None), (False, "media", None), (True, "document", "c.docx"), (False, "media", None)]
    assert _optimized(found).count("file attached\\s") == 6


def test_lengths_are_counted_in_place(spark):
    ev = events(spark, [("a", at(minute=i), t) for i, t in enumerate(["x_y 𝒳 12", "", "..."])])
    measured = volume.measured(ev)
    assert [(r.chars, r.words) for r in measured.orderBy("id").collect()] == [(9, 4), (0, 1), (3, 1)]
    assert _optimized(measured).count("regexp_extract_all") == 1 and "regexp_replace" not in _optimized(measured)


def test_words_are_filtered_without_patterns(spark):
    ev = events(spark, [("a", at(minute=i), t) for i, t in enumerate(["httpx wwwx river 123 12a river", "a_b river-boat"])])
    assert {(r.kind, r.value, r.n) for r in words.frequencies(ev).collect()} == {("word", "river", 3), ("word", "httpx", 1), ("word", "wwwx", 1), ("word", "12a", 1), ("word", "boat", 1)}
    assert {(r.word, r.n) for r in words.top_words(ev).collect()} == {("river", 3), ("12a", 1), ("boat", 1)}
    for report in (words.frequencies, words.top_words, words.word_summary, words.top_phrases):
        assert "RLIKE" not in _optimized(report(ev)) and "split(" not in _optimized(report(ev))


def test_phrases_of_equal_texts_are_found_once(spark, monkeypatch):
    said = ["river boat sails", "river boat sails", None, "river boat", "river boat sails", "x"]
    ev = events(spark, [("a", at(minute=i), t) for i, t in enumerate(said)]).coalesce(1)
    for held in (words.HELD, 20):
        monkeypatch.setattr(words, "HELD", held)
        rows = sorted(map(tuple, words.repeated_texts(ev).collect()))
        assert held == 20 or rows == [("d", "river boat", 1), ("d", "river boat sails", 3), ("d", "x", 1)]
        assert [(r.phrase, r.n) for r in words.top_phrases(ev).orderBy("rank").collect()] == [("river boat", 4), ("boat sails", 3)]
    assert "MapInArrow" in _optimized(words.top_phrases(ev))


def test_digests_of_months_in_rounds_of_days(spark, monkeypatch):
    spent, discard = [], sinks.discard
    monkeypatch.setattr(sinks, "discard", lambda *tables: (spent.extend(tables), discard(*tables)))
    rows = [(f"d{i % 3}", i // 2, at(minute=i * 977), f"text {i}\nline" if i % 7 else None, "u" if i % 2 else None) for i in range(150)] + [(None, 1, at(), "n", "u"), ("d1", 1, None, "z", "u")]
    ev = spark.createDataFrame(rows, "dataset_id string, id long, ts timestamp_ntz, content string, actor string")
    days = sinks._rounds(ev, 7)
    assert len(days) > 10 and all(a <= z for a, z in days) and all(z < a for (_, z), (a, _) in zip(days, days[1:]))
    got = sorted(map(tuple, sinks.month_digests(ev, 40).collect()))
    assert spent and got == sorted(map(tuple, sinks.month_digests(ev).collect()))
    import hashlib

    assert got == sorted((r.dataset_id, r.month, r.messages, hashlib.sha256(r.text.encode()).hexdigest()) for r in sinks.month_pages(ev).collect())
