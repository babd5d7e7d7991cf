"""Text logs, JSON exports, tables, archives, normalization and streams, on literal files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.times import parse_ts
from tidewell.operators import documents, relations
from tidewell.operators.normalize import normalize, resolve_entities
from tidewell.sources import records, sinks
from tidewell.streaming import live


def put(folder, name, lines):
    (folder / name).write_text("\n".join(lines) if isinstance(lines, list) else lines, encoding="utf-8")
    return str(folder / name)


def got(df):
    return [(r.actor, r.content, r.event_type) for r in df.orderBy("source_file", "line_no").collect()]


def test_chat_log(spark, tmp_path):
    path = put(tmp_path, "chat.txt", ["banner one", "banner two", "[12/01/2024, 9:05:00 AM] Ann: hello", "second line", "", "[12/01/2024, 9:06:00 AM] group created", "2024-01-13 10:00 - Боб: да", "bad \x01 line"])
    df = records.read_chat_log(spark, path)
    assert got(df) == [(None, "banner one\nbanner two", "unstructured"), ("Ann", "hello\nsecond line", "message"), (None, "group created", "system"), ("Боб", "да", "message")]
    assert [r.ts for r in df.orderBy("line_no").collect()] == [None, dt.datetime(2024, 1, 12, 9, 5), dt.datetime(2024, 1, 12, 9, 6), dt.datetime(2024, 1, 13, 10)]
    with pytest.raises(Exception, match="binary"):
        records.read_chat_log(spark, path, "legacy").collect()
    big = put(tmp_path, "big.txt", [f"[2024-01-01 10:{i % 60:02d}:00] A: m{i}" for i in range(10_000)])
    assert records.read_chat_log(spark, big).count() == 10_000
    long = put(tmp_path, "long.txt", ["[2024-01-01 10:00:00] A: " + "x" * 50, "more"])
    assert records.read_chat_log(spark, long, max_len=20).first().content == "x" * 20 + " [TRUNCATED DUE TO SIZE]"
    assert records.read_chat_log(spark, put(tmp_path, "empty.txt", [])).count() == 0


def test_other_dialects(spark, tmp_path):
    signal = put(tmp_path, "signal.txt", ["[2024-01-12 09:05] Ann: hi", "  more ", "[2024-01-12 09:06] Bob: Attachment: a.png"])
    assert [(r.actor, r.content, r.has_media) for r in records.read_chat_log(spark, signal, "signal").orderBy("line_no").collect()] == [("Ann", "hi\nmore", False), ("Bob", "Attachment: a.png", True)]
    im = put(tmp_path, "im.txt", ["2024-01-12 09:05:01 +4912: hi", "noise", "2024-01-12 09:06:01 Bob: yo"])
    assert got(records.read_chat_log(spark, im, "imessage")) == [("+4912", "hi", "message"), ("Bob", "yo", "message")]
    disc = put(tmp_path, "discord.txt", ["[12-Jan-24 09:05 PM] Ann#1234", "body", "[2024-01-12 21:06] Bob", "[Image: x]"])
    rows = records.read_chat_log(spark, disc, "discord").orderBy("line_no").collect()
    assert [(r.actor, r.has_media) for r in rows] == [("Ann#1234", False), ("Bob", True)] and rows[0].ts == dt.datetime(2024, 1, 12, 21, 5) and "body" in rows[0].content
    txt = put(tmp_path, "t.txt", ["[2024/01/12, 09:05:00] Ann: hi", "[2024-01-12 09:06:00] someone joined"])
    assert [x[2] for x in got(records.read_chat_log(spark, txt, "text"))] == ["message", "system"]


def test_json(spark, tmp_path):
    nd = put(tmp_path, "a.ndjson", ['{"sender": "Ann", "timestamp": "2024-01-12T09:05:00Z", "message": "hi"}', "{broken", '{"a": 1, "b": "x"}'])
    rows = records.read_ndjson(spark, nd).orderBy("line_no").collect()
    assert [(r.actor, r.content, r.event_type) for r in rows] == [("Ann", "hi", "record"), (None, "{broken", "unstructured"), (None, "a: 1 | b: x", "record")]
    assert rows[0].ts == dt.datetime(2024, 1, 12, 9, 5) and "parseError" in rows[1].metadata
    env = put(tmp_path, "env.json", json.dumps({"name": "n", "messages": [{"type": "message", "date": "2024-01-12T09:05:00", "from": "Ann", "text": ["see ", {"type": "link", "text": "this"}]}, {"from": "Bob", "text": "yo", "photo": "p.jpg"}]}))
    rows = records.read_json_export(spark, env).orderBy("line_no").collect()
    assert [(r.actor, r.content, r.event_type, r.has_media) for r in rows] == [("Ann", "see this", "message", False), ("Bob", "yo", "record", True)]
    disc = put(tmp_path, "d.json", json.dumps({"guild": {"id": "g"}, "channel": {"id": "c"}, "messages": [{"id": "1", "type": "Default", "timestamp": "2024-01-12T09:05:00", "author": {"id": "9", "name": "ann", "nickname": "nick", "discriminator": "1337"}, "content": "hi", "attachments": [{"url": "http://x/y.png"}]}, {"author": {"name": "bob", "discriminator": "0"}, "content": ""}]}))
    rows = records.read_json_export(spark, disc, "discord").orderBy("line_no").collect()
    assert [(r.actor, r.content, r.has_media) for r in rows] == [("nick#1337", "hi [Attachment: http://x/y.png]", True), ("bob", "[Empty message]", False)]
    slack = put(tmp_path, "s.json", json.dumps([{"type": "message", "user": "U1", "user_profile": {"display_name": "ann"}, "text": "see <http://x.y|here> and <@U2>", "ts": "1705050300.000100"}, {"type": "channel_join", "text": "x"}, {"text": ""}]))
    (r,) = records.read_json_export(spark, slack, "slack").collect()
    assert (r.actor, r.content, r.ts) == ("ann", "see here (http://x.y) and @U2", dt.datetime(2024, 1, 12, 9, 5, 0))
    im = put(tmp_path, "i.json", json.dumps([{"date": 726678000000000000, "sender": "+49", "text": "hi", "is_from_me": False}]))
    assert records.read_json_export(spark, im, "imessage").first().ts == dt.datetime(2024, 1, 11, 15)


def test_delimited(spark, tmp_path):
    path = put(tmp_path, "a.csv", ['Name,Date,Score,Notes', 'Ann,2024-01-12,95,"a, ""b"""', "Bob,,,"])
    rows = records.read_delimited(spark, path).orderBy("line_no").collect()
    assert [(r.actor, r.content) for r in rows] == [("Ann", 'Name: Ann | Date: 2024-01-12 | Score: 95 | Notes: a, "b"'), ("Bob", "Name: Bob")]
    assert rows[0].ts == dt.datetime(2024, 1, 12) and rows[1].ts == dt.datetime(2024, 1, 1, 10)
    tsv = put(tmp_path, "b.tsv", ["author\ttimestamp\tmessage", "Ann\t2024-01-12 09:05:00\thi"])
    assert records.read_delimited(spark, tsv).first().actor == "Ann"
    assert records.detect_delimiter("a;b;c,d") == ";" and records.detect_delimiter("abc") == ","


def test_archives_and_catalog(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("chat.txt", "12/01/2024, 09:05 - Ann: hi\n12/01/2024, 09:06 - Bob: yo\n")
        z.writestr("a.jpg", b"1")
        z.writestr("b.mp4", b"2")
    rows = records.read_archives(spark, f"{tmp_path}/*.zip").orderBy("line_no").collect()
    assert [(r.actor, json.loads(r.metadata)["archiveMediaCount"]) for r in rows] == [("Ann", 2), ("Bob", 2)]
    put(tmp_path, "n.txt", "abc")
    assert {r.format for r in records.catalog_files(spark, str(tmp_path)).collect()} == {"zip", "txt"}
    put(tmp_path, "zero.txt", "")
    assert records.catalog_files(spark, str(tmp_path)).where("path like '%zero.txt'").count() == 0


def test_delimited_files_keep_their_own_headers_and_all_cells(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t", "a.csv", ["name,score", "Ann,5," + ",".join(f"x{i}" for i in range(12)), "Bob"])
    put(tmp_path / "t", "b.tsv", ["author\tdate\tnote", 'Cyd\t2024-01-12\t"two\tcells\nand ""lines"""'])
    put(tmp_path / "t", "c.csv", ["name,,name", "Dan,b,c"])
    rows = {r.actor: r for r in records.read_delimited(spark, str(tmp_path / "t")).collect()}
    assert rows["Ann"].content == "name: Ann | score: 5" and rows["Bob"].content == "name: Bob"
    data = json.loads(rows["Ann"].metadata)["rowData"]
    assert [data[f"extra_{i + 3}"] for i in range(12)] == [f"x{i}" for i in range(12)]
    assert rows["Cyd"].content == 'author: Cyd | date: 2024-01-12 | note: two\tcells\nand "lines"' and rows["Cyd"].ts == dt.datetime(2024, 1, 12)
    assert rows["Dan"].content == "name: Dan | column_2: b | name_3: c"
    assert [r.line_no for r in rows.values() if r.actor in ("Ann", "Bob")] == [1, 2]


def test_json_export_beyond_a_variant(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"name": "n", "messages": [')
        f.write(",".join(json.dumps({"from": "Ann", "text": f"{i} " + "x" * 1000}) for i in range(150_000)))
        f.write("]}")
    r = records.read_json_export(spark, str(tmp_path / "big.json")).agg(F.count("*"), F.countDistinct("content"), F.min(F.length("content"))).first()
    assert tuple(r) == (150_000, 150_000, 1002)


def test_json_items_of_any_kind(spark, tmp_path):
    path = put(tmp_path, "odd.json", '\n [{"from": "Ann", "text": "a"}, "plain", 7]')
    assert [r.actor for r in records.read_json_export(spark, path).orderBy("line_no").collect()] == ["Ann", None, None]
    one = put(tmp_path, "one.json", '{"from": "Ann", "text": "only"}')
    assert got(records.read_json_export(spark, one)) == [("Ann", "only", "record")]
    lines = put(tmp_path, "lines.json", ['{"from": "Ann", "text": "a"}', "{broken", '{"from": "Bob", "text": "b"}'])
    assert [x[0] for x in got(records.read_json_export(spark, lines))] == ["Ann", "Bob"]
    assert [x[2] for x in got(records.read_json_export(spark, put(tmp_path, "bad.json", "[{]"), "discord"))] == ["unstructured"]


def test_mixed_archive_and_folder(spark, tmp_path):
    ndjson = '{"sender": "Eve", "message": "n1"}\n{"sender": "Fay", "message": "n2"}\n'
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("chat.txt", "12/01/2024, 09:05 - Ann: hi\n")
        z.writestr("export.json", json.dumps({"messages": [{"from": "Bob", "text": "yo"}]}))
        z.writestr("sub/table.csv", 'name;note\nCyd;"a\nb"\n')
        z.writestr("sub/lines.ndjson", ndjson)
        z.writestr("p.png", b"1")
    found = records.read_archives(spark, f"{tmp_path}/*.zip").collect()
    assert {(r.actor, r.content) for r in found} == {("Ann", "hi"), ("Bob", "yo"), ("Cyd", "name: Cyd | note: a\nb"), ("Eve", "n1"), ("Fay", "n2")}
    assert {json.loads(r.metadata)["innerPath"] for r in found} == {"chat.txt", "export.json", "sub/table.csv", "sub/lines.ndjson"}
    put(tmp_path, "discord_a.txt", ["[2024-01-12 21:06] Gus", "hey"])
    put(tmp_path, "more.jsonl", ndjson)
    put(tmp_path, "notes.txt", ["[2024-01-12 09:05:00] Hal: note"])
    assert {r.actor for r in records.read_any(spark, str(tmp_path)).collect()} == {"Ann", "Bob", "Cyd", "Eve", "Fay", "Gus", "Hal"}
    put(tmp_path, "t.xlsx", "x")
    with pytest.raises(ValueError, match="xlsx"):
        records.read_any(spark, str(tmp_path))


def test_times(spark):
    cases = {"2024-01-12T09:05:00Z": "2024-01-12 09:05:00", "13/02/2024 10:00": "2024-02-13 10:00:00", "02/13/2024": "2024-02-13 00:00:00", "1705050300": "2024-01-12 09:05:00", "1705050300000": "2024-01-12 09:05:00", "Jan 5, 2024": "2024-01-05 00:00:00", "12-Jan-24 09:05 PM": "2024-01-12 21:05:00", "nonsense": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_ts(F.col("s")).cast("string").alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases


def test_normalize(spark, tmp_path):
    path = put(tmp_path, "chat.txt", ["[2024-01-12 09:05:00] Ann: see https://x.y/z 😂😂 ok then", "[2024-01-12 09:06:00] ann : again", "banner"])
    events, rejects = normalize(records.read_chat_log(spark, path), "d")
    first = events.orderBy("sequence_num").first()
    assert first.has_urls and first.has_emojis and first.emojis == ["😂"] and first.char_length == len(first.content) + 2 and rejects.count() == 0
    assert resolve_entities(events).count() == 1 and events.select("id").distinct().count() == 2


def _normalized(spark, lines, **more):
    rows = [(f, n, "a", dt.datetime(2024, 1, 1), "2024", f"{f}{n} https://x.y" if n != 4 else None, None, None, None) for f, n in lines]
    made = spark.createDataFrame(rows, "source_file string, line_no long, actor string, ts timestamp, raw_timestamp string, content string, event_type string, has_media boolean, metadata string")
    return normalize(made, "d", **more)[0]


def test_texts_nobody_asks_for_are_not_numbered(spark):
    events = _normalized(spark, [("f", n) for n in (3, 1, 4, 2)])
    asked = events.select("id", "sequence_num", "char_length", "has_urls")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted")
    moved = [line for node, line in zip(plan.split("\n"), plan.split("\n")[1:]) if ") Exchange" in node and line.startswith("Input")]
    assert moved and not any("content#" in line for line in moved)
    assert [(r.sequence_num, r.has_urls) for r in asked.orderBy("sequence_num").collect()] == [(1, True), (2, True), (3, True)]


def test_counted_lines_equal_sorted_ones(spark):
    usual = [(f, n) for f in ("a", "b", None) for n in (0, 1, 2, 4, 7, 8, 9, 63, 64, 32_766, 32_767, 32_768, 65_536, 9_000_000)]
    for lines, native in ((usual, True), (usual + [("c", 5), ("c", -2)], False), (usual + [("c", 5), ("c", 5)], False), (usual + [("c", None)], False), ([], True)):
        counted, sorted_ = (_normalized(spark, lines, count_lines=x) for x in (True, False))
        key = lambda df: sorted((str(r.source_file), r.sequence_num, r.content) for r in df.collect())
        if ("c", 5) not in lines or ("c", -2) in lines:
            assert key(counted) == key(sorted_)
        assert [x[:2] for x in key(counted)] == [x[:2] for x in key(sorted_)]
        assert ("row_number" not in counted._jdf.queryExecution().optimizedPlan().toString()) == native


def test_scalar_functions(spark):
    t = spark.createDataFrame([("😂 🎉", 1.0), ("a😂", 90.0), ("", 7200.0)], "s string, n double")
    assert [r[0] for r in t.select(text.is_pure_emoji(F.col("s"))).collect()] == [True, False, False]
    assert [r[0] for r in t.select(text.duration_label(F.col("n"))).collect()] == ["1s", "2m", "2.0h"]
    assert t.select(text.sanitize_text(F.lit("é\r\nx\x07"))).first()[0] == "é\nx"
    media = {"PTT-1.opus": "audio", "VID-2.mp4 (file attached)": "video", "<image omitted>": "image", "a.vcf": "contact", "b.pdf (file attached)": "document", "sticker": "sticker", "hello": "media"}
    m = spark.createDataFrame([(k,) for k in media], "s string").select("s", text.classify_media(F.col("s"), F.lit(False)).alias("m"))
    assert {r.s: r.m.type for r in m.collect()} == media


def test_documents_and_gradebook(spark):
    docs = spark.createDataFrame([(0, "spark engines scale well\n\nthis paragraph is dated 2024-03-05 here", "a"), (1, "spark engines scale badly", "b"), (2, None, "c")], "doc_id long, text string, source string")
    assert documents.document_similarity(docs, min_percent=1).count() == 1
    events = documents.documents_to_events(docs).collect()
    assert {str(e.ts) for e in events if e.actor == "a"} == {"2024-01-01 00:00:00", "2024-03-05 00:00:00"}
    g = spark.createDataFrame([("x", 95, 90, 92), ("y", 55, 70, 60)], "Student string, Math int, Science int, English int")
    assert documents.is_gradebook(documents.profile_columns(g))
    report = documents.gradebook_report(g, "Student", ["Math", "Science", "English"])
    assert {r.actor: r.gpa for r in report["gpa"].collect()} == {"x": 3.62, "y": 2.08}
    assert [(r.subject, r.mean) for r in report["weak"].collect()] == [("Math", 55.0), ("English", 60.0)]


def test_paragraphs_keep_their_digits(spark):
    docs = spark.createDataFrame([(1, "a", "0997523947200283 begins with zero\n\n 1 is what this paragraph ends with 1 ")], "doc_id long, source string, text string")
    assert sorted(e.content for e in documents.documents_to_events(docs).collect()) == ["0997523947200283 begins with zero", "1 is what this paragraph ends with 1"]


@pytest.fixture
def stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(str(i), "d", "ab"[i % 2], base + dt.timedelta(seconds=20 * i + (3600 if i >= 40 else 0) + (90_000 if i >= 59 else 0)), "message", "urgent help" if i == 7 else "x") for i in range(60)]
    ev = spark.createDataFrame(rows, "id string, dataset_id string, actor string, ts timestamp, event_type string, content string")
    ev.write.parquet(f"{tmp_path}/in")
    return ev, spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")


def run(spark, sdf, name, mode):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, stream):
    ev, sdf = stream
    threads = run(spark, live.stream_threads(sdf), "threads_t", "append")
    closed = relations.threads(ev, limit=None)
    assert sorted((r.start_ts, r.messages) for r in threads.collect()) == sorted((r.start_ts, r.messages) for r in closed.collect())
    assert run(spark, live.stream_volume(sdf), "volume_t", "complete").agg(F.sum("messages")).first()[0] == 60
    assert run(spark, live.stream_bursts(sdf, least=15), "bursts_t", "append").count() > 0
    assert [r.id for r in run(spark, live.stream_urgency(sdf), "urgent_t", "append").collect()] == ["7"]


def test_stream_ingest(spark, tmp_path):
    from tidewell.operators.volume import entity_rollup

    (tmp_path / "drop").mkdir()
    ingest = lambda: live.stream_ingest(spark, f"{tmp_path}/drop", f"{tmp_path}/out", f"{tmp_path}/cp", "d").awaitTermination(120)
    put(tmp_path / "drop", "a.ndjson", ['{"sender": "Ann", "timestamp": "2024-01-12T09:05:00Z", "message": "hi"}', '{"sender": "Bob", "timestamp": "2024-01-12T09:06:00Z", "message": "yo"}', "{broken"])
    ingest()
    ingest()
    put(tmp_path / "drop", "b.ndjson", ['{"sender": "ann", "timestamp": "2024-01-13T09:05:00Z", "message": "again"}'])
    put(tmp_path / "drop", "c.ndjson", ['{"sender": "Cyd", "timestamp": "2024-01-11T09:05:00Z", "message": "first"}'])
    ingest()
    events = spark.read.parquet(f"{tmp_path}/out/events")
    assert events.count() == 4 and spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1
    want = sorted(map(tuple, entity_rollup(events).collect()))
    state = lambda: sorted(map(tuple, live.read_rollup(spark, f"{tmp_path}/out/rollup").select("dataset_id", "entity", "events", "chars", "first_ts", "last_ts").collect()))
    assert state() == want and len(want) == 3
    # A batch that runs again, alone or after a write that broke off, changes nothing.
    last = max(live._versions(spark, f"{tmp_path}/out/rollup"))
    (tmp_path / "out" / "rollup" / f"version={last}" / "_SUCCESS").unlink()
    for _ in range(2):
        live.merge_batch(spark, f"{tmp_path}/out/rollup", last, entity_rollup(spark.read.parquet(f"{tmp_path}/out/events/batch={last}")))
        assert state() == want
    assert live.read_rollup(spark, f"{tmp_path}/nothing") is None


def test_load_keeps_rejects_and_fails_without_a_good_record(spark, tmp_path):
    path = put(tmp_path, "a.ndjson", ['{"sender": "Ann", "timestamp": "2024-01-12T09:05:00Z", "message": "hi"}', "{broken", '{"sender": "Bob", "message": "no time"}'])
    for _ in range(2):
        assert sinks.load(records.read_ndjson(spark, path), "d", f"{tmp_path}/t") == (1, 2)
    assert [r.actor for r in sinks.read_events(spark, f"{tmp_path}/t/events").where("dataset_id = 'd'").collect()] == ["Ann"]
    with pytest.raises(ValueError, match="none of 2"):
        sinks.load(records.read_ndjson(spark, put(tmp_path, "b.ndjson", ["{broken", "more"])), "e", f"{tmp_path}/t")
    assert {r.dataset_id for r in sinks.read_events(spark, f"{tmp_path}/t/events").collect()} == {"d"}
    with pytest.raises(ValueError, match="none of 0"):
        sinks.load(records.read_ndjson(spark, put(tmp_path, "c.ndjson", [""])), "f", f"{tmp_path}/t")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_stream_responses_of_shuffled_events_equal_the_batch(spark, tmp_path, rocks):
    import os
    import random

    from tidewell.operators import volume

    r, base = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(str(i), f"d{i % 2}", r.choice(["a", "b", None, "c"]), base + dt.timedelta(seconds=r.randrange(9000), microseconds=r.randrange(10**6)), "message", "x") for i in range(300)]
    late = dt.timedelta(days=2)
    batches = [rows[0::4], rows[1::4], rows[2::4], rows[3::4], [("z", f"d{k}", "z", base + late, "message", "x") for k in (0, 1)], [("zz", "d0", "z", base + 2 * late, "message", "x")]]
    schema = "id string, dataset_id string, actor string, ts timestamp, event_type string, content string"
    for k, part in enumerate(batches):
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
        (name,) = (tmp_path / f"b{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{k}.parquet"
        target.write_bytes(name.read_bytes())
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = run(spark, live.stream_responses(sdf, delay="3 hours"), "responses_t", "append").collect()
    batch = volume.response_samples(spark.createDataFrame(rows, schema)).collect()
    assert sorted((x.dataset_id, x.actor, round(x.secs, 6)) for x in found if x.actor != "z") == sorted((x.dataset_id, x.actor, round(x.secs, 6)) for x in batch)


def test_custom_reader(spark, tmp_path):
    records.register_reader("lines", lambda s, path: s.read.text(path).select(F.lit(path).alias("source_file"), F.lit(0).alias("line_no"), F.lit("x").alias("actor"), F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("raw_timestamp"), F.col("value").alias("content"), F.lit("message").alias("event_type"), F.lit(False).alias("has_media"), F.lit(None).cast("string").alias("metadata")))
    try:
        assert records.READERS["lines"](spark, put(tmp_path, "l.txt", ["a", "b"])).columns == records.COLUMNS
    finally:
        del records.READERS["lines"]
    xlsx = put(tmp_path, "t.xlsx", "cell")
    records.register_reader("xlsx", lambda s, paths: records.read_chat_log(s, paths))
    try:
        assert got(records.read_any(spark, xlsx)) == [(None, "cell", "unstructured")]
    finally:
        del records.READERS["xlsx"]


def test_stream_bursts_equal_batch_windows(spark, stream):
    ev, sdf = stream
    live_rows = run(spark, live.stream_bursts(sdf, least=15), "bursts_b", "append")
    batch = ev.groupBy("dataset_id", F.window("ts", "5 minutes", "1 minute")).count().where("count >= 15")
    assert sorted(r.messages for r in live_rows.collect()) == sorted(r["count"] for r in batch.collect())
