"""Queries over documents, conversations, vectors and the star schema, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DATE, EMOJI, STOP_WORDS, URL
from ..functions import text
from ..functions.times import parse_ts
from ..operators import documents as d
from ..operators import search
from ..operators.normalize import normalize, resolve_entities
from ..operators.vectors import VectorIndex, recall
from ..shared import materialize
from ..sources import ranges, records
from .reports import quoted
from .testbed import WITH_EV, table, testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


_TOK = f"tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{3,}}'), lambda x: x NOT IN ({quoted(STOP_WORDS)})) AS w FROM documents), un AS (SELECT doc_id, unnest(list_distinct(w)) AS token FROM tok)"
add("document_topics", on("documents", d.document_topics), f"WITH {_TOK} SELECT token, count(*) AS documents FROM un GROUP BY token ORDER BY documents DESC, token LIMIT 10")
_STATS = f"""st AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS words, greatest(1, CAST(ceil(coalesce(length(text), 0) / 3000) AS BIGINT)) AS pages, array_to_string(regexp_extract_all(coalesce(text, ''), '{DATE}')[1:20], ',') AS dates FROM tok JOIN documents USING (doc_id))"""
add("document_stats", on("documents", lambda t: d.document_stats(t).withColumn("dates", F.array_join("dates", ","))), f"WITH {_TOK}, {_STATS} SELECT * FROM st")
add("document_totals", on("documents", lambda t: d.document_totals(d.document_stats(t))), f"WITH {_TOK}, {_STATS} SELECT count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(pages) AS BIGINT) AS pages FROM st")
_PAIR = f"""WITH {_TOK}, n AS (SELECT doc_id, count(*) AS n FROM un GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM un a JOIN un b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
j AS (SELECT a, b, 100.0 * k / (x.n + y.n - k) AS s FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b) """
add("document_similarity", on("documents", d.document_similarity), _PAIR + "SELECT a, b, CAST(round(s) AS BIGINT) AS percent FROM j")
add("most_similar", on("documents", lambda t: d.most_similar_documents(t, min_percent=50)), _PAIR + "SELECT a, b, CAST(round(s) AS BIGINT) AS percent FROM j WHERE s >= 50 ORDER BY percent DESC, a, b LIMIT 1")
add("paragraph_events", on("documents", lambda t: d.documents_to_events(t).select("id", "dataset_id", "actor", F.col("ts").cast("string").alias("ts"), "event_type", F.md5("content").alias("content"))), f"""WITH s AS (SELECT doc_id, source, text, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: length(p) > 20) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, CASE WHEN len(p) > 0 THEN p WHEN text = '' THEN ['Empty document section'] ELSE [substr(text, 1, 1000)] END AS p FROM s), r AS (SELECT doc_id, source, unnest(range(len(p))) AS pos, unnest(p) AS content FROM l),
t AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(content, '{DATE}'), '') AS TIMESTAMP), TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 DAY + pos * INTERVAL 10 MINUTE) AS ts FROM r)
SELECT sha256('documents|' || doc_id || '|' || pos) AS id, 'documents' AS dataset_id, source AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'message' AS event_type, md5(content) AS content FROM t""")
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
add("profile_orders", on("orders", lambda t: d.profile_columns(t.select(*_ORDERS), None).select("column", "filled", "kind")), "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM orders" for c in _ORDERS) + """),
k AS (SELECT "column", count(v) AS filled, count(try_cast(v AS DOUBLE)) AS numbers, count(CASE WHEN regexp_matches(v, '[-/]') THEN try_cast(v AS TIMESTAMP) END) AS dates FROM c GROUP BY "column")
SELECT "column", filled, CASE WHEN dates > 0 THEN 'date' WHEN filled > 0 AND numbers = filled THEN 'number' ELSE 'text' END AS kind FROM k""")
add("column_stats", on("lineitem", lambda t: d.column_stats(t, ["l_quantity", "l_extendedprice", "l_discount"])), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(sum({c}::DOUBLE) / count(*), 2) AS average, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
_GRADE = "g AS (SELECT l_suppkey::VARCHAR AS actor, 'tax' AS subject, avg(l_tax::DOUBLE * 1000) AS mean FROM lineitem GROUP BY l_suppkey UNION ALL SELECT l_suppkey::VARCHAR, 'quantity', avg(l_quantity::DOUBLE * 2) FROM lineitem GROUP BY l_suppkey)"
_grades = lambda t: d.gradebook_report(t.select(F.col("l_suppkey").cast("string").alias("name"), (F.col("l_tax").cast("double") * 1000).alias("tax"), (F.col("l_quantity").cast("double") * 2).alias("quantity")), "name", ["tax", "quantity"])
add("gradebook_gpa", on("lineitem", lambda t: _grades(t)["gpa"]), f"WITH {_GRADE} SELECT actor, round(least(4.0, greatest(0.0, avg(mean) / 20 - 1)), 2) AS gpa FROM g GROUP BY actor")
add("gradebook_means", on("lineitem", lambda t: _grades(t)["means"]), f"WITH {_GRADE} SELECT actor, subject, round(mean, 2) AS mean FROM g")
add("gradebook_weak", on("lineitem", lambda t: _grades(t)["weak"].select("actor", "subject")), f"WITH {_GRADE} SELECT actor, subject FROM g WHERE mean < 70 ORDER BY mean, actor, subject LIMIT 50")

# ---------------------------------------------------------------- scalar functions over whole tables

add("text_functions", on("documents", lambda t: t.select(
    "doc_id", text.utf16_len(F.col("text")).cast("long").alias("units"), text.word_count(F.col("text")).cast("long").alias("words"), F.size(text.url_matches(F.col("text"))).cast("long").alias("urls"), F.size(text.date_matches(F.col("text"))).cast("long").alias("dates"),
    text.ellipsize(F.col("text"), 60).alias("title"), F.md5(text.html_escape(F.col("text"))).alias("escaped"),
)), rf"""SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS units,
  CAST(len(list_filter(string_split_regex(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '{URL.replace("'", "''")}')) AS BIGINT) AS urls, CAST(len(regexp_extract_all(text, '{DATE}')) AS BIGINT) AS dates,
  CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS title, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS escaped FROM documents""")  # fmt: skip
add("date_parts", on("events", lambda t: t.select("event_id", F.hour("ts").alias("hour"), text.dow0(F.col("ts")).alias("dow"), F.month("ts").alias("month"), F.year("ts").alias("year"), F.to_date("ts").cast("string").alias("day"), text.week_monday(F.col("ts")).cast("string").alias("monday"))),
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday FROM events")
add("parse_times", on("events", lambda t: t.select("event_id", *[(parse_ts(F.date_format("ts", f), dayfirst)).cast("string").alias(n) for n, f, dayfirst in (("iso", "yyyy-MM-dd HH:mm:ss", False), ("day_first", "dd/MM/yyyy, HH:mm:ss", True), ("named", "MMM d, yyyy", False))], parse_ts(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("string").alias("epoch"))),
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS day_first, strftime(ts, '%Y-%m-%d 00:00:00') AS named, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS epoch FROM events")
add("emoji_functions", lambda spark, sf: testbed(spark, sf).select("id", text.is_pure_emoji(F.element_at(F.split("content", " "), -1)).alias("pure"), F.array_join(F.transform(text.emoji_matches(F.col("content")), text.emoji_to_hex), " ").alias("hex")),
    WITH_EV + f"z AS (SELECT 1) SELECT id, length(regexp_replace(string_split(content, ' ')[-1], '{EMOJI}|[\\s\\x{{FE0F}}\\x{{200D}}]', '', 'g')) = 0 AND length(string_split(content, ' ')[-1]) > 0 AS pure, array_to_string(list_transform(regexp_extract_all(content, '{EMOJI}'), lambda x: lower(to_hex(unicode(x)))), ' ') AS hex FROM ev")
add("media_types", lambda spark, sf: testbed(spark, sf).select("id", text.classify_media(F.concat("content", F.when(F.col("id") % 3 == 0, F.lit(" VID-1.mp4 (file attached)")).when(F.col("id") % 3 == 1, F.lit(" <image omitted>")).otherwise(F.lit(""))), F.lit(False)).alias("m")).select("id", "m.*"),
    WITH_EV + "z AS (SELECT 1) SELECT id, id % 3 <> 2 AS is_media, CASE id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'media' END AS type, CASE id % 3 WHEN 0 THEN 'VID-1.mp4' END AS filename FROM ev")
add("sanitize", on("pages", lambda t: t.select("page_id", F.md5(text.sanitize_text(F.col("html"))).alias("clean"))), r"SELECT page_id, md5(regexp_replace(regexp_replace(nfc_normalize(html), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS clean FROM pages")

# ---------------------------------------------------------------- sources and normalization over given tables


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as lines of a chat log, one file a conversation: a turn's further lines continue its message."""
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn")), "dd/MM/yyyy, HH:mm:ss")
    body = F.concat(F.lit("["), stamp, F.lit("] "), "role", F.lit(": "), F.coalesce("text", F.lit("")))
    lines = c.select(F.col("conv_id").cast("string").alias("source_file"), "turn", F.posexplode(F.split(body, "\n")).alias("k", "line"))
    return lines.select("source_file", (F.col("turn").cast("long") * (1 << 32) + F.col("k")).alias("line_no"), "line")


add("chat_log", lambda spark, sf: records.records_from_lines(chat_lines(spark, sf)).select("source_file", "actor", F.col("ts").cast("string").alias("ts"), F.md5("content").alias("content"), "event_type"),
    r"""SELECT conv_id::VARCHAR AS source_file, trim(role) AS actor, strftime(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts,
  md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), chr(10))) AS content, 'message' AS event_type FROM conversations""")
add("json_lines", lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", records.json_record(F.try_parse_json(F.to_json(F.struct(F.col("role").alias("sender"), F.col("text").alias("message"), F.lit("2024-02-03 04:05:06").alias("date")))), F.col("turn")).alias("r")).select("conv_id", "turn", "r.actor", F.col("r.ts").cast("string").alias("ts"), F.md5("r.content").alias("content")),
    "SELECT conv_id, turn, trim(role) AS actor, '2024-02-03 04:05:06' AS ts, md5(text) AS content FROM conversations")
def dialect_lines(spark: SparkSession, sf_dir: str, head: str, fmt: str) -> DataFrame:
    """The conversations as lines of another log: ``head`` has {stamp}, {who} and {text}."""
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn")), fmt)
    before, between, after = head.replace("{text}", "").replace("{who}", "{stamp}").split("{stamp}")
    body = F.concat(F.lit(before), stamp, F.lit(between), "role", F.lit(after), F.coalesce("text", F.lit("")))
    lines = c.select(F.col("conv_id").cast("string").alias("source_file"), "turn", F.posexplode(F.split(body, "\n")).alias("k", "line"))
    return lines.select("source_file", (F.col("turn").cast("long") * (1 << 32) + F.col("k")).alias("line_no"), "line")


# Each dialect's lines, how its times are written, and SQL of the text that its records keep of all non-blank lines.
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
for _dialect, _head, _fmt in (("signal", "[{stamp}] {who}: {text}", "yyyy-MM-dd HH:mm"), ("imessage", "{stamp} {who}: {text}", "yyyy-MM-dd HH:mm:ss"), ("text", "[{stamp}] {who}: {text}", "yyyy/MM/dd, HH:mm:ss")):
    add(f"log_{_dialect}", lambda spark, sf, d=_dialect, h=_head, f=_fmt: records.records_from_lines(dialect_lines(spark, sf, h, f), d).select("source_file", "actor", F.col("ts").cast("string").alias("ts"), F.md5(F.regexp_replace("content", r"\s+", " ")).alias("content"), "event_type"),
        f"""SELECT conv_id::VARCHAR AS source_file, trim(role) AS actor, strftime(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts,
  md5(regexp_replace({'coalesce(string_split(text, chr(10))[1], chr(0))' if _dialect == "imessage" else f"array_to_string({_LINES}, chr(10))"}, '\\s+', ' ', 'g')) AS content, 'message' AS event_type FROM conversations""")


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON exports in pieces, one a turn: each fifth turn's message is no object, and each seventh conversation lacks its end."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    of = Window.partitionBy("conv_id").orderBy("turn")
    item = F.when(F.col("turn") % 5 == 4, F.to_json(F.array("text"), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(F.col("role").alias("sender"), F.col("text").alias("message")), {"ignoreNullFields": "false"}))
    first, last = F.lag("turn").over(of).isNull(), F.lead("turn").over(of).isNull()
    begin = F.when(first, F.lit('{"name": "a } b", "members": [{"id": 1}], "messages": [')).otherwise(F.lit(", "))
    end = F.when(last & (F.col("conv_id") % 7 != 0), F.lit('], "count": {"n": 1}}')).otherwise(F.lit(""))
    return c.select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(begin, item, end).alias("value"))


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = json_text(spark, sf_dir)
    found, broken, _ = ranges.json_items(ranges.braced(pieces), records.CONTAINERS["generic"])
    v = F.col("v")
    good = records.with_value(found, "item").select("source_file", F.col("line_no").cast("long").alias("line_no"), F.md5(F.coalesce(F.try_variant_get(v, "$.message", "string"), F.try_variant_get(v, "$[0]", "string"), F.lit("none"))).alias("content"))
    return good.unionByName(broken.select("source_file", F.lit(-1).cast("long").alias("line_no"), F.lit("broken").alias("content")))


add("json_export_items", json_export, """SELECT conv_id::VARCHAR AS source_file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, md5(coalesce(text, 'none')) AS content FROM conversations WHERE conv_id % 7 <> 0
UNION ALL SELECT DISTINCT conv_id::VARCHAR, -1, 'broken' FROM conversations WHERE conv_id % 7 = 0""")
add("ndjson_kinds", lambda spark, sf: records.records_from_ndjson(table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("line_no"),
    F.concat(F.to_json(F.struct(F.col("lang").alias("sender"), F.col("text").alias("message"))), F.when(F.col("doc_id") % 3 == 1, F.lit("{}")).when(F.col("doc_id") % 3 == 2, F.lit(" ")).otherwise(F.lit(""))).alias("line"))).select("line_no", "actor", "event_type", F.md5(F.when(F.col("event_type") == "record", F.col("content"))).alias("content")),
    """SELECT doc_id AS line_no, CASE WHEN doc_id % 3 <> 1 THEN trim(lang) END AS actor, CASE WHEN doc_id % 3 = 1 THEN 'unstructured' ELSE 'record' END AS event_type,
  CASE WHEN doc_id % 3 <> 1 THEN md5(CASE WHEN coalesce(text, '') = '' THEN concat_ws(' | ', 'sender: ' || lang) ELSE text END) END AS content FROM documents""")
add("rows_to_events", on("nation", lambda t: records.rows_to_events(t.withColumnRenamed("n_name", "name"), ["n_nationkey"], "nation").select("line_no", "actor", F.col("ts").cast("string").alias("ts"), "event_type")),
    "SELECT CAST(n_nationkey + 1 AS INTEGER) AS line_no, n_name AS actor, strftime(TIMESTAMP '2024-01-01 08:00:00' + (n_nationkey + 1) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, 'record' AS event_type FROM nation")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = testbed(spark, sf_dir)
    return ev.select(F.lit("t").alias("source_file"), F.col("id").alias("line_no"), "actor", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("string").alias("raw_timestamp"), "content", "event_type", F.lit(False).alias("has_media"), F.lit(None).cast("string").alias("metadata"))


add("normalize", lambda spark, sf: normalize(_records(spark, sf), "d")[0].select("id", "entity_id", "sequence_num", F.col("char_length").cast("long").alias("char_length"), F.col("word_count").cast("long").alias("word_count"), "has_urls", "has_emojis"),
    WITH_EV + f"""z AS (SELECT 1) SELECT sha256('d|t|' || id) AS id, sha256(lower(trim(actor))) AS entity_id, row_number() OVER (ORDER BY id) AS sequence_num, chars AS char_length,
  CAST(len(list_filter(string_split_regex(regexp_replace(content, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, contains(content, 'https://') AS has_urls, regexp_matches(content, '{EMOJI}') AS has_emojis FROM m""")
add("entities", lambda spark, sf: resolve_entities(testbed(spark, sf)).select("entity_id", "normalized", "name"), WITH_EV + "z AS (SELECT 1) SELECT DISTINCT sha256(lower(trim(actor))) AS entity_id, lower(trim(actor)) AS normalized, trim(actor) AS name FROM ev WHERE actor IS NOT NULL")

# ---------------------------------------------------------------- vectors


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.nearest(v, v.where("vec_id % 20 = 0"), 10).select("query", F.col("id").alias("neighbour"), "rank")


add("nearest_vectors", _nearest, """WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS neighbour, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS c FROM q JOIN embeddings ON vec_id <> query)
SELECT query, neighbour, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS rank FROM s) WHERE rank <= 10""")
def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours from the index, searched exactly."""
    v = table(spark, sf_dir, "embeddings")
    return VectorIndex.build(v).search(v.where("vec_id % 20 = 0"), 10, exact=True).select("query", F.col("id").alias("neighbour"), "rank")


def _index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probing the index finds of the exact neighbours."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0")
    found = recall(VectorIndex.build(v).search(queries, 10), search.nearest(v, queries, 10))
    return found.select("neighbours", (F.col("recall") >= 0.9).alias("enough"))


def _similar_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each twentieth document, the ten documents whose hashed vectors are most similar, by the index."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", search.embed("text").alias("v"))
    rows = materialize(docs, "document-vectors")
    index = VectorIndex.build(rows, "doc_id", "v")
    return index.search(rows.where("doc_id % 20 = 0"), 10, exact=True, id_col="doc_id", col="v").select("query", F.col("id").alias("neighbour"), "rank", F.round("similarity", 6).alias("similarity"))


add("nearest_indexed", _indexed, ORACLES["nearest_vectors"])
add("index_recall", _index_recall, "SELECT sum(least(10, (SELECT count(*) FROM embeddings) - 1))::BIGINT AS neighbours, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
add("documents_indexed", _similar_messages)
add("message_cosine", lambda spark, sf: testbed(spark, sf).select("id", F.round(search.similarity(F.col("content"), "urgent server error"), 4).alias("similarity")))
add("conversation_lengths", on("conversations", lambda t: t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(text.utf16_len(F.col("text"))).cast("long").alias("units"))),
    r"SELECT conv_id, count(*) AS turns, CAST(sum(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) AS BIGINT) AS units FROM conversations GROUP BY conv_id")
