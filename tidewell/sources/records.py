"""Records of text logs, JSON exports, delimited tables and archives, as DataFrames.

Each reader gives: source_file, line_no, actor, ts, raw_timestamp, content,
event_type, has_media, metadata (JSON). A time that can't be read is null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import apple_ts, slack_markup
from ..functions.times import parse_ts
from ..shared import materialize
from .archives import archive_pieces, detect_delimiter
from .ranges import STRETCH, braced, json_items, json_pieces, lines_of_pieces, text_lines

COLUMNS = ["source_file", "line_no", "actor", "ts", "raw_timestamp", "content", "event_type", "has_media", "metadata"]

# The line formats of chat logs: groups are date, time, actor, text.
_SLASHED, _TIME = r"(\d{1,2}/\d{1,2}/\d{2,4}),?\s+", r"(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)"
_ISO = r"(\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)"
_WHO = r"\s+([^:]+):\s+(.*)$"
CHAT = [rf"^\[{_SLASHED}{_TIME}\]{_WHO}", rf"^{_SLASHED}{_TIME}\s+-{_WHO}", rf"^\[{_ISO}()\]{_WHO}", rf"^{_ISO}()\s+-{_WHO}"]
CHAT_SYSTEM = [rf"^\[{_SLASHED}{_TIME}\]\s+()(.*)$", rf"^{_SLASHED}{_TIME}\s+-\s+()(.*)$"]
_NAME = r"\s+([^#\n:]+(?:#\d{4})?)(?::\s*|\s*-\s*|\s+)?(.*)$"
DIALECTS = {
    "chat": (CHAT, CHAT_SYSTEM),
    "text": ([*CHAT, rf"^\[(\d{{4}}/\d{{1,2}}/\d{{1,2}}),?\s+{_TIME}\]{_WHO}"], [*CHAT_SYSTEM, rf"^\[{_ISO}()\]\s+()(.*)$"]),
    "legacy": (CHAT, CHAT_SYSTEM),
    "discord": ([rf"^\[(\d{{1,2}}-[A-Za-z]{{3}}-\d{{2,4}})\s+(\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*[APap][Mm])\]{_NAME}", rf"^\[{_ISO}()\]{_NAME}"], []),
    "signal": ([r"^\[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}(?::\d{2})?)()\]\s+([^:]+):\s*(.*)$"], []),
    "imessage": ([r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})()\s+([^:]+):\s*(.*)$"], []),
}
MEDIA = {"discord": r"(?i)\[(Attachment|Image|Video|File):|https://(cdn|media)\.discordapp\.(com|net)", "signal": r"(?i)Attachment:"}
BINARY = r"[\x00-\x08\x0E-\x1F]"


def records_from_lines(lines: DataFrame, dialect: str = "chat", max_len: int = 65_536, on_binary: str = "drop", dayfirst: bool = True) -> DataFrame:
    """Records of log lines (source_file, line_no, line).

    A line that starts a message or a notice starts a record; other lines
    continue the record before them in their file, or a banner. Lines with
    binary characters are dropped, or fail the query with ``on_binary='fail'``.
    Records are cut at ``max_len`` characters.
    """
    heads, notices = DIALECTS[dialect]
    bad = F.contains("line", F.lit("\x00")) | F.substring("line", 1, 100).rlike(BINARY)
    if on_binary == "fail":
        lines = lines.withColumn("line", F.when(bad, F.raise_error(F.lit("a line holds binary data")).cast("string")).otherwise(F.col("line")))
    else:
        lines = lines.where(~bad)
    line = F.trim("line") if dialect in ("discord", "imessage") else F.col("line")
    lines = lines.where(F.length(F.trim("line")) > 0).withColumn("line", line)
    kind, fields = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for pattern, label in [*reversed([(p, "system") for p in notices]), *reversed([(p, "message") for p in heads])]:
        hit = F.col("line").rlike(pattern)
        kind = F.when(hit, F.lit(label)).otherwise(kind)
        fields = F.when(hit, F.array(*[F.regexp_extract("line", pattern, g) for g in (1, 2, 3, 4)])).otherwise(fields)
    marked = lines.select("*", kind.alias("kind"), fields.alias("f"))
    if dialect == "imessage":
        marked = marked.where("kind is not null")
    # The last head before a line, in its part or an earlier one.
    part = F.col("part") if "part" in lines.columns else F.floor(F.col("line_no") / STRETCH)
    marked = marked.withColumns({"part": part, "head": F.when(F.col("kind").isNotNull(), F.col("line_no"))})
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads_before = marked.groupBy("source_file", "part").agg(F.max("head").alias("head")).select(F.col("source_file").alias("_f"), F.col("part").alias("_p"), F.max("head").over(earlier).alias("_head"))
    in_part = Window.partitionBy("source_file", "part").orderBy("line_no")
    own_head = marked.withColumn("own", F.max("head").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = own_head.join(heads_before, (F.col("source_file") == F.col("_f")) & (F.col("part") == F.col("_p"))).withColumn("rec", F.coalesce("own", "_head", F.lit(-1)))
    if dialect in ("discord", "signal"):
        grouped = grouped.where("rec >= 0")
    own = F.when(F.col("kind").isNotNull(), F.col("f")[3]).otherwise(F.trim("line") if dialect == "signal" else F.col("line"))
    cut = F.when(F.length(own) > max_len, F.concat(F.substring(own, 1, max_len), F.when(F.col("kind") == "message", F.lit(" [TRUNCATED DUE TO SIZE]")).when(F.col("kind") == "system", F.lit(" [TRUNCATED]")).otherwise(F.lit("")))).otherwise(own)
    cells = grouped.select("source_file", "part", "rec", "line_no", "kind", "f", cut.alias("text"))
    # Lines that begin beyond the record's limit don't show, so a record of any number of lines collects a bounded text.
    so_far = cells.groupBy("source_file", "rec", "part").agg(F.sum(F.length("text") + 1).alias("chars"))
    offset = so_far.select(F.col("source_file").alias("_f"), F.col("rec").alias("_r"), F.col("part").alias("_p"), F.coalesce(F.sum("chars").over(Window.partitionBy("source_file", "rec").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_chars"))
    in_record = Window.partitionBy("source_file", "part", "rec").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_in", F.coalesce(F.sum(F.length("text") + 1).over(in_record), F.lit(0))).join(offset, (F.col("source_file") == F.col("_f")) & (F.col("rec") == F.col("_r")) & (F.col("part") == F.col("_p")))
    shown = placed.where((F.col("_in") + F.col("_chars") <= max_len) | F.col("kind").isNotNull())
    rec = shown.select("source_file", "rec", "line_no", "kind", "f", F.col("text").alias("part")).groupBy("source_file", "rec").agg(
        F.first("kind", ignorenulls=True).alias("kind"), F.first("f", ignorenulls=True).alias("f"), F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    head = F.length(F.col("parts")[0]["part"])
    content = F.when(F.length(joined) > F.greatest(F.lit(max_len), head), F.substring(joined, F.lit(1), F.greatest(F.lit(max_len), head))).otherwise(joined)
    raw = F.trim(F.concat_ws(" ", F.col("f")[0], F.nullif(F.col("f")[1], F.lit(""))))
    media = F.coalesce(F.col("content").rlike(MEDIA[dialect]), F.lit(False)) if dialect in MEDIA else F.lit(False)
    out = rec.select("source_file", "line_no", "kind", raw.alias("raw_timestamp"), F.nullif(F.trim(F.col("f")[2]), F.lit("")).alias("actor"), content.alias("content"))
    return out.select(
        "source_file", "line_no", F.when(F.col("kind") == "message", F.col("actor")).alias("actor"), parse_ts(F.nullif("raw_timestamp", F.lit("")), dayfirst).alias("ts"), F.nullif("raw_timestamp", F.lit("")).alias("raw_timestamp"),
        "content", F.coalesce("kind", F.lit("unstructured")).alias("event_type"), media.alias("has_media"), F.lit(None).cast("string").alias("metadata"),
    )


def read_chat_log(spark: SparkSession, path: str | list[str], dialect: str = "chat", **options) -> DataFrame:
    if dialect == "legacy":
        options.setdefault("on_binary", "fail")
    return records_from_lines(text_lines(spark, path), dialect, **options)


# ---------------------------------------------------------------- JSON


def _str(v: Column, path: str) -> Column:
    """A field as text; null if it is absent, null, empty or no scalar."""
    raw = F.try_variant_get(v, f"$.{path}", "string")
    return F.nullif(raw, F.lit(""))


def _pick(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_str(v, p) for p in paths])


#: What a line is followed by when it is parsed, so that a value with something after it is told from one alone.
_ALONE = "tidewell: nothing follows"


def once(value: Column, name: str) -> Column:
    """A column that is computed once a row: conditions on it aren't moved to before it, where its text would be parsed for each of its uses."""
    return F.explode(F.array(value)).alias(name)


def with_value(df: DataFrame, text: str) -> DataFrame:
    """Adds v, a text's JSON value as a variant; null if it isn't one value and nothing else."""
    pair = df.select("*", once(F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f'\n,"{_ALONE}"]'))), "_pair"))
    alone = (F.size(F.try_variant_get("_pair", "$", "array<variant>")) == 2) & (F.try_variant_get("_pair", "$[1]", "string") == _ALONE)
    return pair.select("*", once(F.when(alone, F.try_variant_get("_pair", "$[0]", "variant")), "v")).drop("_pair")


def _size(v: Column, path: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, f"$.{path}", "array<variant>")), F.lit(0))


def rich_text(v: Column, path: str) -> Column:
    """A text, or an array of texts and objects with one, joined."""
    parts = F.try_variant_get(v, f"$.{path}", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))), "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.when(parts.isNull(), _str(v, path)))


def json_record(v: Column, index: Column) -> Column:
    """A JSON object as struct(actor, ts, raw_timestamp, content, event_type, has_media, metadata): the first field that is there of each role."""
    raw = _pick(v, "timestamp", "date", "time", "created_at", "createdAt", "date_unixtime")
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    pairs = F.filter(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), F.when(~F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(e["value"], "$", "string")).alias("v"))), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    flat = F.nullif(F.array_join(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), " | "), F.lit(""))
    body = F.coalesce(*[rich_text(v, p) for p in ("content", "text", "message", "body", "summary", "description")], flat, F.concat(F.lit("Record #"), index.cast("string")))
    kind = F.coalesce(_str(v, "type"), _str(v, "eventType"), F.when(_str(v, "media_type").isNotNull(), F.lit("media")), F.lit("record"))
    media = reduce(lambda a, b: a | b, [F.coalesce(F.try_variant_get(v, f"$.{p}", "variant").isNotNull(), F.lit(False)) for p in ("photo", "file", "media_type", "attachment")])
    return F.struct(
        F.trim(_pick(v, "actor", "sender", "from", "from_name", "author", "user", "username", "name")).alias("actor"), parse_ts(raw).alias("ts"), raw.alias("raw_timestamp"),
        body.alias("content"), kind.alias("event_type"), media.alias("has_media"), F.to_json(v).alias("metadata"),
    )


def _unparsed(line: Column) -> Column:
    """The record of a text that is no JSON: its first 1000 characters, and all of it in metadata."""
    none = lambda t: F.lit(None).cast(t)
    meta = F.to_json(F.struct(F.lit("not JSON").alias("parseError"), line.alias("rawLine")))
    return F.struct(none("string").alias("actor"), none("timestamp").alias("ts"), none("string").alias("raw_timestamp"), F.substring(line, 1, 1000).alias("content"), F.lit("unstructured").alias("event_type"), F.lit(False).alias("has_media"), meta.alias("metadata"))


def _scalar(v: Column, index: Column) -> Column:
    """The record of a JSON value that is neither object nor array: the value as text."""
    none = lambda t: F.lit(None).cast(t)
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null"))
    meta = F.to_json(F.struct(F.to_json(v).alias("rawValue"), index.alias("index")))
    return F.struct(none("string").alias("actor"), none("timestamp").alias("ts"), none("string").alias("raw_timestamp"), text.alias("content"), F.lit("record").alias("event_type"), F.lit(False).alias("has_media"), meta.alias("metadata"))


def _any_record(v: Column, index: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), json_record(v, index)).otherwise(_scalar(v, index))


def records_from_ndjson(lines: DataFrame) -> DataFrame:
    """One value a line (source_file, line_no, line); a line that isn't one JSON value and nothing else is kept as an unstructured record."""
    lines = with_value(lines.where(F.length(F.trim("line")) > 0), "line")
    made = lines.select("source_file", "line_no", once(F.when(F.col("v").isNotNull(), _any_record(F.col("v"), F.col("line_no") + 1)).otherwise(_unparsed(F.col("line"))), "r"))
    return made.select("source_file", "line_no", "r.*")


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return records_from_ndjson(text_lines(spark, path))


# The keys below the root that hold an export's records, in the order in which they are tried.
CONTAINERS = {"generic": ("messages", "records", "events", "data", "items"), "discord": ("messages",)}


def records_from_json(pieces: DataFrame, lines: DataFrame, kind: str = "generic") -> DataFrame:
    """Records of JSON texts in pieces: generic, discord, slack or imessage exports.

    An item that can't be parsed is kept as an unstructured record. A generic or
    slack text whose brackets don't match is read by its ``lines`` (source_file,
    line_no, line), of which those that are one object are records; any other
    such text is one unstructured record, so that no file is lost.
    """
    items, broken, fields = json_items(pieces, CONTAINERS.get(kind, ()))
    rows = with_value(items, "item")
    if kind in ("generic", "slack"):
        left = lines.join(broken.select(F.col("source_file").alias("_f")), F.col("source_file") == F.col("_f"), "left_semi").select("source_file", F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("item"))
        rows = rows.unionByName(with_value(left, "item").where(F.schema_of_variant("v").startswith("OBJECT")))
    if kind == "discord":
        value = F.regexp_extract("field", r'(?s)\A\s*"id"\s*:\s*"?([^"]*?)"?\s*\z', 1)
        named = lambda k: F.max(F.when((F.col("key") == k) & F.col("field").rlike(r'\A\s*"id"\s*:'), value)).alias(k)
        ids = fields.groupBy(F.col("source_file").alias("_f")).agg(named("channel"), named("guild"))
        rows = rows.join(ids, F.col("source_file") == F.col("_f"), "left")
    v = F.col("v")
    made = {"generic": lambda: _any_record(v, F.col("line_no") + 1), "discord": lambda: _discord(v), "slack": lambda: _slack(v), "imessage": lambda: _imessage(v)}[kind]()
    out = rows.select("source_file", "line_no", once(F.when(v.isNotNull(), made).otherwise(_unparsed(F.col("item"))), "r")).where("r is not null").select("source_file", "line_no", "r.*")
    if kind in ("generic", "slack"):
        return out
    begin = F.min_by(F.substring("value", 1, 1000), F.struct("part", "seq"))
    lost = pieces.join(broken.select(F.col("source_file").alias("_f")), F.col("source_file") == F.col("_f"), "left_semi").groupBy("source_file").agg(begin.alias("item"))
    return out.unionByName(lost.select("source_file", F.lit(0).cast("long").alias("line_no"), _unparsed(F.col("item")).alias("r")).select("source_file", "line_no", "r.*"))


def read_json_export(spark: SparkSession, path: str | list[str], kind: str = "generic") -> DataFrame:
    """Records of JSON files: generic, discord, slack or imessage exports."""
    return records_from_json(json_pieces(spark, path), text_lines(spark, path), kind)


def _discord(v: Column) -> Column:
    tag = _str(v, "author.discriminator")
    name = F.coalesce(_pick(v, "author.nickname", "author.name", "author.username", "author.id"))
    full = F.concat(name, F.when(tag.isNotNull() & ~tag.isin("0", "0000"), F.concat(F.lit("#"), tag)).otherwise(F.lit("")))
    files = F.try_variant_get(v, "$.attachments", "array<variant>")
    urls = F.array_join(F.transform(files, lambda a: F.coalesce(F.try_variant_get(a, "$.url", "string"), F.try_variant_get(a, "$.fileName", "string"), F.lit("attachment"))), " ")
    mark = F.when(F.size(files) > 0, F.concat(F.lit("[Attachment: "), urls, F.lit("]")))
    body = F.nullif(F.concat_ws(" ", _pick(v, "content", "text", "message"), mark), F.lit(""))
    raw = _pick(v, "timestamp", "timestampEdited", "created_at", "date")
    meta = F.to_json(F.struct(_str(v, "id").alias("id"), F.coalesce(_str(v, "channelId"), F.col("channel")).alias("channelId"), F.coalesce(_str(v, "guildId"), F.col("guild")).alias("guildId"), F.to_json(F.try_variant_get(v, "$.reactions", "variant")).alias("reactions"), F.try_variant_get(v, "$.isPinned", "boolean").alias("isPinned")))
    media = (_size(v, "attachments") > 0) | (_size(v, "embeds") > 0) | F.coalesce(F.try_variant_get(v, "$.hasMedia", "boolean"), F.lit(False))
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.author", "variant")) == "STRING", _str(v, "author"))
    return F.struct(F.coalesce(full, plain, F.lit("Unknown")).alias("actor"), parse_ts(raw).alias("ts"), raw.alias("raw_timestamp"), F.coalesce(body, F.lit("[Empty message]")).alias("content"), F.coalesce(_str(v, "type"), F.lit("message")).alias("event_type"), media.alias("has_media"), meta.alias("metadata"))


def _slack(v: Column) -> Column:
    raw, thread = _str(v, "ts"), _str(v, "thread_ts")
    meta = F.to_json(F.struct(F.lit("slack").alias("platform"), thread.alias("threadTs"), F.coalesce(thread != raw, F.lit(False)).alias("isThreadReply")))
    made = F.struct(
        F.coalesce(_pick(v, "user_profile.display_name", "user_profile.real_name", "username", "user"), F.lit("Slack User")).alias("actor"), F.timestamp_millis(F.floor(raw.try_cast("decimal(20,6)") * 1000).cast("long")).alias("ts"), raw.alias("raw_timestamp"),
        slack_markup(F.coalesce(_str(v, "text"), F.lit(""))).alias("content"), F.lit("message").alias("event_type"), (_size(v, "files") > 0).alias("has_media"), meta.alias("metadata"),
    )
    keep = F.coalesce(_str(v, "type"), F.lit("message")) == "message"
    return F.when(keep & (_str(v, "text").isNotNull() | (_size(v, "files") > 0)), made)


def _imessage(v: Column) -> Column:
    raw = _str(v, "date")
    when = F.coalesce(apple_ts(raw.try_cast("bigint")), parse_ts(raw))
    meta = F.to_json(F.struct(F.lit("imessage").alias("platform"), F.coalesce(F.try_variant_get(v, "$.is_from_me", "boolean"), F.lit(False)).alias("isFromMe"), F.coalesce(_str(v, "service_name"), F.lit("iMessage")).alias("service")))
    return F.struct(
        F.coalesce(_pick(v, "sender", "handle", "from"), F.lit("Me")).alias("actor"), when.alias("ts"), raw.alias("raw_timestamp"), F.coalesce(_pick(v, "text", "content", "body"), F.lit("")).alias("content"),
        F.lit("message").alias("event_type"), (_size(v, "attachments") > 0).alias("has_media"), meta.alias("metadata"),
    )


# ---------------------------------------------------------------- tables

# Column names that tell a row's actor and time.
ACTOR = re.compile("^(name|actor|sender|student|student_name|candidate|user|author|person|employee|from)$", re.I)
WHEN = re.compile("^(date|timestamp|time|datetime|created_at|term|period|semester|quarter|year|month)$", re.I)


def detect_roles(columns: list[str]) -> tuple[str | None, str | None]:
    """The first columns named as an actor and as a time."""
    first = lambda p: next((c for c in columns if p.match(c.strip())), None)
    return first(ACTOR), first(WHEN)


def _place(names: Column, pattern: re.Pattern) -> Column:
    """The place, from 1, of the first column whose name has a role; 0 for none."""
    return F.coalesce(F.array_position(F.transform(names, lambda n: F.trim(n).rlike(f"(?i){pattern.pattern}")), True), F.lit(0))


def cells_to_events(rows: DataFrame, sheet: str | None = None, base: str = "2024-01-01 08:00:00", actor_in_content: bool = True) -> DataFrame:
    """Rows (source_file, line_no from 1, names, cells) as records: roles by column names, text as ``column: value`` of all filled cells.

    ``names`` and ``cells`` are arrays of texts. A blank name becomes column_i,
    one that came before gets its place, and cells beyond the names are extra_i
    in the metadata alone, however many there are. Without a time a row comes
    an hour after the one before.
    """
    named = F.transform("names", lambda n, i: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    rows = rows.withColumn("names", named)
    rows = rows.withColumn("names", F.transform("names", lambda n, i: F.when(F.array_position(F.col("names"), n) <= i, F.concat(n, F.lit("_"), (i + 1).cast("string"))).otherwise(n)))
    rows = rows.withColumns({"_actor": _place(F.col("names"), ACTOR), "_when": _place(F.col("names"), WHEN)})
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    cell = lambda at: F.when(F.col(at) > 0, filled(F.try_element_at("cells", F.col(at).cast("int"))))
    shown = F.transform("names", lambda n, i: F.when(F.lit(actor_in_content) | (i + 1 != F.col("_actor")), F.concat(n, F.lit(": "), filled(F.get("cells", i)))))
    body = F.array_join(F.array_compact(shown), " | ")
    width = F.greatest(F.size("names"), F.size("cells"))
    keys = F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.get("names", i - 1), F.concat(F.lit("extra_"), i.cast("string"))))
    values = F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.get("cells", i - 1), F.lit("")))
    n, raw = F.col("line_no"), cell("_when")
    meta = F.to_json(F.struct(F.lit(sheet).alias("sheetName"), n.alias("rowIndex"), F.map_from_arrays(keys, values).alias("rowData")))
    return rows.select(
        "source_file", n.alias("line_no"), cell("_actor").alias("actor"), F.coalesce(parse_ts(raw), F.when(raw.isNull(), F.to_timestamp(F.lit(base)) + F.make_dt_interval(F.lit(0), n))).alias("ts"), raw.alias("raw_timestamp"),
        F.coalesce(F.nullif(body, F.lit("")), F.concat(F.lit("Row #"), n.cast("string"))).alias("content"), F.lit("record").alias("event_type"), F.lit(False).alias("has_media"), meta.alias("metadata"),
    )


def rows_to_events(df: DataFrame, order: list[str], sheet: str | None = None, base: str = "2024-01-01 08:00:00", actor_in_content: bool = True) -> DataFrame:
    """Any table's rows as records, as cells_to_events makes them.

    Rows are numbered from 1 by ``order``, as a row's time may hang on its
    number. They are dealt out by ranges of it and written once; a range's
    numbers go on from the rows of the ranges before. Rows of equal order come
    by a digest of the row.
    """
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    row = F.struct(F.lit(sheet).cast("string").alias("source_file"), F.array(*[F.lit(c) for c in df.columns]).alias("names"), cells.alias("cells"))
    keys = [f"_k{i}" for i in range(len(order))]
    placed = df.select(row.alias("_row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)], F.xxhash64(cells).alias("_tie"))
    ranged = placed.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    written = materialize(ranged.select("_row", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "rows")
    sizes = written.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))  # a row for each range
    numbered = written.join(starts, F.col("_range") == F.col("_r")).select("_row.*", (F.col("_before") + F.col("_at") + 1).cast("int").alias("line_no"))
    return cells_to_events(numbered, sheet, base, actor_in_content)


def _cells_of(record: Column, sep: str) -> Column:
    """All cells of a delimited record's text."""
    s = re.escape(sep)
    cut = F.regexp_extract_all(record, F.lit(f'(?s)(?:^|{s})("(?:[^"]|"")*"|[^{s}]*)'), F.lit(1))
    return F.transform(cut, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "auto", base: str = "2024-01-01 08:00:00") -> DataFrame:
    """Delimited files' rows as records. Each file has its own header and delimiter; files with the same header are read together."""
    begin = spark.read.text(path).where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("value").alias("head"))
    groups = begin.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()  # names of files alone
    none = spark.createDataFrame([], "source_file string, line_no int, names array<string>, cells array<string>")
    made = []
    for head, files in groups:
        own = detect_delimiter(head) if sep == "auto" else sep
        read = spark.read.option("sep", own).option("quote", '"').option("escape", '"').option("multiLine", True)
        names = [h or "" for h in read.csv(files).first()]
        cols = [f"c{i}" for i in range(len(names))]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cols, "_record"]])
        rows = read.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_record").schema(schema).csv(files)
        # A record with too many cells comes with its text, from which all of them are cut; one with too few has nulls.
        plain = F.array(*cols)
        cells = F.when(F.col("_record").isNull(), plain).otherwise(F.concat(plain, F.slice(_cells_of(F.col("_record"), own), len(names) + 1, 1 << 30)))
        made.append(rows.select(F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("at"), F.array(*[F.lit(n) for n in names]).alias("names"), cells.alias("cells")))
    if not made:
        return cells_to_events(none, None, base)
    # A file is read by one task, so its rows lie one after the other there.
    at = Window.partitionBy("source_file")
    numbered = [m.withColumn("line_no", (F.col("at") - F.min("at").over(at) + 1).cast("int")).drop("at") for m in made]
    return cells_to_events(reduce(DataFrame.unionByName, numbered), None, base)


# ---------------------------------------------------------------- archives and files

def _entry_reader(name: Column) -> Column:
    """How an archive's entry is read, by its name: text or json and the dialect, ndjson, or csv."""
    kind = route(name)
    dialect = F.when(kind.isin("discord", "imessage", "signal", "chat"), kind).otherwise(F.lit("text"))
    export = F.when(kind.isin("discord", "imessage", "slack"), kind).otherwise(F.lit("generic"))
    low = F.lower(name)
    return F.when(low.rlike(r"\.(csv|tsv)$"), F.lit("csv")).when(low.rlike(r"\.(ndjson|jsonl)$"), F.lit("ndjson")).when(low.endswith(".json"), F.concat(F.lit("json "), export)).otherwise(F.concat(F.lit("text "), dialect))


def read_archives(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """Records of all data entries of archives, each by the reader of its format, with archive, entry and number of media in metadata.

    The entry's own metadata lies below ``entry``. An archive or entry that
    can't be read is an unstructured record without a time, whose metadata has
    the error as parseError; what could be read of it, and all others, load.
    """
    pieces = archive_pieces(spark, glob).select("*", F.concat_ws("!", "source_file", "inner_path").alias("file"), _entry_reader(F.element_at(F.split("inner_path", "/"), -1)).alias("kind"))
    good = pieces.where("error is null")
    of = lambda k: good.where(F.col("kind") == k)
    text = lambda k: of(k).select(F.col("file").alias("source_file"), "part", F.lit(0).cast("long").alias("seq"), "value")
    lost = pieces.where("error is not null").select(F.col("file").alias("source_file"), F.col("part").alias("line_no"), _unparsed(F.lit("")).alias("r"), "error").select("source_file", "line_no", "r.*", "error")
    parts = [lost.withColumn("metadata", F.to_json(F.struct(F.col("error").alias("parseError")))).drop("error")]
    for kind in sorted(r["kind"] for r in good.select("kind").distinct().collect()):  # names of formats
        way, _, dialect = kind.partition(" ")
        if way == "csv":
            parts.append(cells_to_events(of(kind).select(F.col("file").alias("source_file"), F.col("part").cast("int").alias("line_no"), "names", "cells")))
        elif way == "ndjson":
            parts.append(records_from_ndjson(lines_of_pieces(text(kind))))
        elif way == "json":
            parts.append(records_from_json(braced(text(kind)), lines_of_pieces(text(kind)), dialect))
        else:
            parts.append(records_from_lines(lines_of_pieces(text(kind)), dialect))
    facts = pieces.groupBy(F.col("file").alias("_f"), "inner_path", F.col("source_file").alias("archive")).agg(F.max("media_count").alias("media_count"))
    found = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts]).join(facts, F.col("source_file") == F.col("_f"))
    error = F.get_json_object("metadata", "$.parseError")
    meta = F.to_json(F.struct(F.col("archive").alias("archiveSource"), F.col("inner_path").alias("innerPath"), F.col("media_count").alias("archiveMediaCount"), error.alias("parseError"), F.try_parse_json("metadata").alias("entry")))
    return found.select(*COLUMNS[:-1], meta.alias("metadata"))


# The formats in the order in which their names are tried.
ROUTES = (
    ("zip", r"\.zip$"), ("discord", r"discord.*\.(json|txt)$"), ("imessage", r"imessage|chat\.db"), ("signal", r"signal"), ("slack", r"slack.*\.json$"), ("csv", r"\.(csv|tsv)$"),
    ("json", r"\.(json|ndjson|jsonl)$"), ("xlsx", r"\.xlsx?$"), ("chat", r"chat.*\.txt$|whatsapp"), ("txt", r"\.(txt|log|md)$"),
)


def route(name: Column) -> Column:
    """The format of a file by its name; txt for any other."""
    out = F.lit("txt")
    for kind, pattern in reversed(ROUTES):
        out = F.when(F.lower(name).rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def _by_extension(json_kind: str, dialect: str):
    """A reader of exports that come as JSON or as text."""

    def read(spark: SparkSession, paths: list[str]) -> DataFrame:
        export = [p for p in paths if p.lower().endswith(".json")]
        text = [p for p in paths if not p.lower().endswith(".json")]
        parts = [read_json_export(spark, export, json_kind)] if export else []
        parts += [read_chat_log(spark, text, dialect)] if text else []
        return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])

    return read


def _read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = [p for p in paths if re.search(r"\.(ndjson|jsonl)$", p, re.I)]
    whole = [p for p in paths if p not in set(lines)]
    parts = [read_ndjson(spark, lines)] if lines else []
    parts += [read_json_export(spark, whole)] if whole else []
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


#: The reader of each format; ``register_reader`` adds or replaces one.
READERS: dict = {
    "zip": read_archives,
    "discord": _by_extension("discord", "discord"),
    "imessage": _by_extension("imessage", "imessage"),
    "signal": _by_extension("generic", "signal"),
    "slack": lambda spark, paths: read_json_export(spark, paths, "slack"),
    "csv": read_delimited,
    "json": _read_json,
    "chat": lambda spark, paths: read_chat_log(spark, paths, "chat"),
    "txt": lambda spark, paths: read_chat_log(spark, paths, "text"),
}


def register_reader(kind: str, reader) -> None:
    """Adds a format: ``reader(spark, paths)`` gives a DataFrame of COLUMNS."""
    READERS[kind] = reader


def read_any(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of all files below ``path``, each by the reader of its format; a format without a reader is an error."""
    named = spark.read.format("binaryFile").load(path).select("path", route(F.element_at(F.split("path", "/"), -1)).alias("format"))
    groups = {r["format"]: r["paths"] for r in named.groupBy("format").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}  # names of files alone
    missing = sorted(set(groups) - set(READERS))
    if missing:
        raise ValueError(f"no reader for {', '.join(missing)}: {groups[missing[0]][0]}")
    if not groups:
        return spark.createDataFrame([], "source_file string, line_no int, actor string, ts timestamp, raw_timestamp string, content string, event_type string, has_media boolean, metadata string")
    return reduce(DataFrame.unionByName, [READERS[kind](spark, paths).select(*COLUMNS) for kind, paths in sorted(groups.items())])


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file's path, bytes, time, SHA-256 and format. Empty files are rejected: Spark's readers pass over them."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), "modificationTime", F.sha2("content", 256).alias("sha256"), route(F.element_at(F.split("path", "/"), -1)).alias("format"))
