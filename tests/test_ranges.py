"""Files cut in byte ranges give what one task gives; malformed JSON and broken archives lose nothing."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.sources import ranges, records
from tidewell.sources.ranges import cut_items

SMALL = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return [tuple(r) for r in df.orderBy("source_file", "line_no").select("line_no", "actor", "content", "event_type", "metadata").collect()]


def test_lines_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    r = random.Random(1)
    lines = ["x" * r.randrange(200) + ("é😀" if i % 7 == 0 else "") for i in range(3000)]
    (tmp_path / "a.txt").write_bytes(("﻿" + "".join(line + r.choice(["\n", "\r\n"]) for line in lines)).encode())
    (tmp_path / "b.txt").write_text("one\ntwo", encoding="utf-8")
    got = ranges.text_lines(spark, str(tmp_path)).orderBy("source_file", "line_no").collect()
    assert len({x.part for x in got}) > 5
    assert [(x.line_no, x.line) for x in got if x.source_file.endswith("a.txt")] == list(enumerate(lines))
    assert [(x.line_no, x.line) for x in got if x.source_file.endswith("b.txt")] == [(0, "one"), (1, "two")]


def test_a_log_in_ranges_equals_the_log_in_one(spark, tmp_path):
    r = random.Random(2)
    log = ["banner"] * 900 + [r.choice([f"[2024-01-01 10:{i % 60:02d}:00] A{i % 5}: m{i}", "goes on " * r.randrange(9), "", f"[12/01/2024, 9:05:00 AM] notice {i}"]) for i in range(4000)]
    path = tmp_path / "log.txt"
    path.write_text("\n".join([*log, *["tail line"] * 6000]), encoding="utf-8")
    want = rows_of(records.read_chat_log(spark, str(path), max_len=500))
    before = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        df = records.read_chat_log(spark, str(path), max_len=500)
        assert ranges.text_lines(spark, str(path)).select("part").distinct().count() > 5
        assert rows_of(df) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # By hand: a head starts a record, other lines go on with it, up to 500 characters.
    records_ = []
    for line in [*log, *["tail line"] * 6000]:
        if line.startswith("[") or not records_:
            records_.append([line.split(": ", 1)[1] if "] A" in line else line.split("] ", 1)[1] if line.startswith("[") else line])
        elif line.strip():
            records_[-1].append(line)
    assert [c for _, _, c, _, _ in want] == ["\n".join(p)[:500] for p in records_]


def test_json_in_ranges_equals_what_python_reads(spark, tmp_path, small_ranges):
    r = random.Random(3)
    odd = ['quote " and } brace', "back\\slash \\", "]},{[", "", "é😀 ", "\\\"}"]
    items = [{"from": f"A{i % 7}", "text": r.choice(odd) + str(i), "more": {"k": [1, {"z": "}"}]}} if i % 10 else r.choice([i, "te}xt,", None, [1, {"a": 2}], True, {}]) for i in range(3000)]
    extra = {"name": "n", "people": [{"from": "not this one"}, {"x": {"y": "}"}}], "count": 3}
    docs = {"root.json": items, "dense.json": items, "env.json": {**extra, "messages": items, "after": {"events": [{"from": "nor this"}]}}, "order.json": {"data": [{"from": "later"}], "records": items[:50]}, "one.json": {"from": "Ann", "text": "only"}, "none.json": [], "bare.json": {"items": [1, 2, "three"]}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=name == "env.json", indent=2 if name == "root.json" else None, separators=(",", ":") if name == "dense.json" else None), encoding="utf-8-sig" if name == "env.json" else "utf-8")
    pieces = ranges.json_pieces(spark, str(tmp_path))
    assert pieces.select("source_file", "part").distinct().count() > 10
    found, broken, _ = ranges.json_items(pieces, records.CONTAINERS["generic"])
    got = {}
    for x in found.orderBy("source_file", "line_no").collect():
        got.setdefault(x.source_file.rpartition("/")[2], []).append((x.line_no, json.loads(x.item.removeprefix("﻿"))))
    want = {"root.json": items, "dense.json": items, "env.json": items, "order.json": items[:50], "one.json": [docs["one.json"]], "bare.json": [1, 2, "three"]}
    assert broken.collect() == []
    assert got.keys() == want.keys()
    for name, expected in want.items():
        assert got[name] == list(enumerate(expected)), name


def test_stretches_are_judged(spark):
    assert cut_items('[{"a":1}', 1, True) == ([("a", None), ("a", '{"a":1}')], False)
    assert cut_items(', 5, "x", {"b":2}', 1, False) == ([(None, "5"), (None, '"x"'), (None, '{"b":2}')], False)
    assert cut_items('], "events": [{"c":1}', 2, False) == ([("-", None), ("aevents", None), ("aevents", '{"c":1}')], False)
    for text, base, first in [('{"b":2}', 1, False), (', , {"b":2}', 1, False), ("]} 5", 2, False), ("]]", 1, False)]:
        assert cut_items(text, base, first)[1], text


def test_malformed_json_loses_nothing(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    lines = ['{"sender":"b","message":"x"}{"sender":"c"}', '"just" text, kept?', "12 apples", '{"sender":"d","message":"y"}', "12", '"text"', "null", "[1,2]", '{"a":1', "]", '1],[2', '{"v":1},{"v":2}']
    rows = records.read_ndjson(spark, put("a.jsonl", "\n".join(lines))).orderBy("line_no").collect()
    kept = [r.content for r in rows if r.event_type == "unstructured"]
    assert kept == [lines[i] for i in (0, 1, 2, 8, 9, 10, 11)]
    assert [json.loads(r.metadata)["rawLine"] for r in rows if r.event_type == "unstructured"] == kept
    assert [(r.actor, r.content) for r in rows if r.event_type == "record"][:4] == [("d", "y"), (None, "12"), (None, "text"), (None, "null")]
    cut = json.dumps([{"from": "Ann", "text": "a"}, {"from": "Bob", "text": "b"}], indent=1)[:-20]
    assert records.read_json_export(spark, put("cut.json", cut)).collect() == []
    flat = put("flat.json", '{"from": "Ann", "text": "a"}\n{broken\n"text"\n{"from": "Bob", "text": "b"} x\n{"from": "Cyd", "text": "c"}')
    assert [r.actor for r in records.read_json_export(spark, flat).orderBy("line_no").collect()] == ["Ann", "Cyd"]
    odd = put("nan.json", '[{"from": "Ann", "text": "a"}, {"from": "Bob", "text": NaN}, {"from": "Cyd", "text": "c"}]')
    rows = records.read_json_export(spark, odd).orderBy("line_no").collect()
    assert [(r.actor, r.event_type) for r in rows] == [("Ann", "record"), (None, "unstructured"), ("Cyd", "record")] and rows[1].content == '{"from": "Bob", "text": NaN}'
    for k, text in enumerate(['[{"a": 1}', '{"messages": [{"a": 1}]', '[{"a": 1}]]', '[{"a": "x]', '[{"a": 1} {"a": 2}]', '[,{"a": 1}]', '{"messages": [{"a": 1}]} x']):
        assert [r.event_type for r in records.read_json_export(spark, put(f"bad{k}.json", text), "discord").collect()] == ["unstructured"], text


def test_broken_archives_are_rejects(spark, tmp_path):
    def made(name, entries, method=zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            for k, v in entries.items():
                z.writestr(k, v)
        return tmp_path / name

    log = "".join(f"12/01/2024, 09:05 - Ann: message {i} " + "x" * (i % 90) + "\r\n" for i in range(20_000))
    export = json.dumps({"messages": [{"from": "Bob", "text": f'{i} "}}" \\'} for i in range(9000)]})
    table = "name,note\n" + "".join(f'Cyd,"{i}\n,b"\n' for i in range(6000))
    made("good.zip", {"_chat.txt": log, "result.json": export, "t.csv": table, "a.jpg": b"1", "deep/empty.txt": ""})
    made("stored.zip", {"discord_a.json": json.dumps({"channel": {"id": "c"}, "guild": {"name": "x", "id": "g"}, "messages": [{"author": {"name": "dan"}, "content": "hi"}]})}, zipfile.ZIP_STORED)
    made("bz.zip", {"x.jsonl": '{"sender": "Eve", "message": "n"}'}, zipfile.ZIP_BZIP2)
    (tmp_path / "no.zip").write_bytes(b"this is no archive")
    whole = made("cut.zip", {"a.txt": "[2024-01-01 10:00:00] Fay: kept", "b.txt": "[2024-01-01 10:00:00] Gus: " + "lost " * 50}).read_bytes()
    at = whole.rindex(b"PK\x03\x04") + 40
    (tmp_path / "cut.zip").write_bytes(whole[:at] + bytes(b ^ 0xFF for b in whole[at : at + 8]) + whole[at + 8 :])
    df = records.read_archives(spark, f"{tmp_path}/*.zip")
    assert df._jdf.queryExecution().executedPlan().toString().count("binaryFile") == 0
    df = df.cache()
    counts = {r.actor: r["count"] for r in df.groupBy("actor").count().collect()}
    assert {k: counts[k] for k in ("Ann", "Bob", "Cyd", "dan", "Eve", "Fay")} == {"Ann": 20_000, "Bob": 9000, "Cyd": 6000, "dan": 1, "Eve": 1, "Fay": 1}
    ann = df.where("actor = 'Ann'").orderBy("line_no").select("content").collect()
    assert [r.content for r in ann] == [line.split("Ann: ")[1].rstrip("\r") for line in log.split("\n")[:-1]]
    assert [r.content for r in df.where("actor = 'Bob'").orderBy("line_no").collect()] == [f'{i} "}}" \\' for i in range(9000)]
    bad = {json.loads(r.metadata)["archiveSource"].rpartition("/")[2]: json.loads(r.metadata)["parseError"] for r in df.where(F.get_json_object("metadata", "$.parseError").isNotNull()).collect()}
    assert bad.keys() == {"no.zip", "cut.zip"} and bad["no.zip"].startswith("no archive")
    dan = json.loads(df.where("actor = 'dan'").first().metadata)
    assert (dan["entry"]["channelId"], dan["entry"]["guildId"]) == ("c", "g")


def test_lines_are_numbered_without_a_shuffle_of_texts(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(2000)))
    with_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = ranges.text_lines(spark, str(tmp_path))
        texts = lines._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert "Scan text" in texts and "Exchange hashpartitioning" not in texts
        got = lines.select("source_file", "part", "line_no", "line").collect()
        assert len({(r.source_file, r.part) for r in got}) > 10
        assert sorted((r.line[0], r.line_no) for r in got) == [(n, i) for n in "ab" for i in range(2000)] and all(r.line == f"{r.line[0]}{r.line_no}" for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_bytes)
