"""Scalar functions over text and time columns, as native expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import DATE, EMOJI, LOOSE_URL, MENTION, NO_EMOJI, NOT_A_NUMBER, URL, WORD


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units: code points beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; an empty array for a null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def emoji_matches(c: Column) -> Column:
    """One match for each emoji code point.

    Stretches without any code point near an emoji go first, by a class of a few
    ranges, so that the class of all emojis is only tried on what is left.
    """
    return found(F.regexp_replace(c, NO_EMOJI, ""), EMOJI)


def url_matches(c: Column, loose: bool = False) -> Column:
    return found(c, LOOSE_URL if loose else URL)


def mention_matches(c: Column) -> Column:
    return F.transform(found(c, MENTION, 1), F.lower)


def date_matches(c: Column) -> Column:
    return found(c, DATE)


def word_matches(c: Column) -> Column:
    """Lower-case runs of three letters or digits and more that aren't digits alone."""
    return found(F.lower(c), NOT_A_NUMBER + WORD)


def word_count(c: Column) -> Column:
    """Runs of letters and digits; other signs and white space part them."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def remove_stop_words(tokens: Column, words: Iterable[str]) -> Column:
    stop = list(words)  # a long list is a hash set
    return F.filter(tokens, lambda w: ~w.isin(stop))


def is_pure_emoji(c: Column) -> Column:
    """Whether nothing but emojis, their joiners and white space is there, and something is."""
    rest = F.regexp_replace(F.regexp_replace(c, EMOJI, ""), r"[\s\x{FE0F}\x{200D}]", "")
    return (F.length(F.trim(c)) > 0) & (F.length(rest) == 0)


def emoji_to_hex(c: Column) -> Column:
    """Code points in lower-case hex, joined by hyphens, without U+FE0F and U+200D."""
    chars = F.filter(F.split(c, ""), lambda x: ~x.isin("", "️", "‍"))
    return F.array_join(F.transform(chars, lambda x: F.lower(F.hex(F.ascii(x)))), "-")


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def sanitize_text(c: Column) -> Column:
    """NFC, with newlines as \\n and without other control characters but tabs."""
    lines = F.regexp_replace(_nfc(c), r"\r\n?", "\n")
    return F.regexp_replace(lines, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def duration_label(secs: Column) -> Column:
    """Seconds as 45s, 12m or 1.5h."""
    minutes = F.concat(F.round(secs / 60).cast("long").cast("string"), F.lit("m"))
    hours = F.concat(F.round(secs / 3600, 1).cast("string"), F.lit("h"))
    return F.when(secs < 60, F.concat(F.round(secs).cast("long").cast("string"), F.lit("s"))).when(secs < 3600, minutes).otherwise(hours)


def dow0(ts: Column) -> Column:
    """The weekday from 0, a Sunday."""
    return F.dayofweek(ts) - 1


def week_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def slack_markup(c: Column) -> Column:
    """Link and mention marks as plain text."""
    c = F.regexp_replace(c, r"<(https?://[^|>]+)\|([^>]+)>", "$2 ($1)")
    c = F.regexp_replace(c, r"<(https?://[^>]+)>", "$1")
    return F.regexp_replace(c, r"<@([A-Z0-9]+)>", "@$1")


def apple_ts(n: Column) -> Column:
    """A number as time: nanoseconds or seconds since 2001, else milliseconds since 1970, told by its size."""
    since_2001 = F.lit(978_307_200_000)
    ms = F.when(n > 10**15, since_2001 + F.floor(n / 10**6)).when(n < 10**11, since_2001 + n * 1000).otherwise(n)
    return F.timestamp_millis(ms.cast("long"))


# Media types in the order in which they are tried: name pattern, extensions, phrases.
MEDIA = (
    ("audio", r"(aud|ptt)-[\w-]+\.", "opus|mp3|m4a|aac|wav|ogg", ("<audio omitted>", "[audio omitted]", "voice note")),
    ("video", r"vid-[\w-]+\.", "mp4|mov|3gp|mkv", ("<video omitted>", "[video omitted]")),
    ("image", r"img-[\w-]+\.", "jpg|jpeg|png|heic", ("<image omitted>", "[image omitted]", "<photo omitted>")),
    ("contact", None, "vcf", ("contact card", ".vcf")),
    ("document", None, "pdf|docx?|xlsx?|pptx?|zip|rar|txt", ("<document omitted>", "[document omitted]")),
    ("sticker", r"stk-[\w-]+\.", "webp", ("sticker", "omitted", "[media", "<media", "(file attached)")),
)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _media_type(low: Column, marked: Column) -> Column:
    """The first media type of a lower-case text; patterns are tried only where a text they need is there."""
    kind = F.when((low == "") & marked, F.lit("sticker"))
    for label, stem, ends, phrases in MEDIA:
        hit = F.contains(low, F.lit("file attached")) & low.rlike(rf"\.({ends})\s*\(\s*file attached\s*\)")
        if stem:
            begins = reduce(lambda a, b: a | b, [F.contains(low, F.lit(f"{x}-")) for x in stem[: stem.index("-")].strip("()").split("|")])
            hit = hit | begins & low.rlike(rf"{stem}({ends})")
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        if label == "sticker":
            hit = hit | marked
        kind = kind.when(hit, F.lit(label))
    return kind


def classify_media(c: Column, has_media: Column) -> Column:
    """struct(is_media, type, filename): the first media type whose marks the text has; a marked event without any is a sticker."""
    marked = F.coalesce(has_media, F.lit(False))

    def typed(text: Column, low: Column, kind: Column) -> Column:
        name = F.lit(None).cast("string")
        for label, _, ends, _ in MEDIA:
            named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(f".{e.rstrip('?')[:3]}")) for e in ends.split("|")])
            name = F.when((kind == label) & named, F.nullif(F.regexp_extract(text, rf"(?i)([^\s/\\:]+\.({ends}))", 1), F.lit(""))).otherwise(name)
        return F.struct(kind.isNotNull().alias("is_media"), F.coalesce(kind, F.lit("media")).alias("type"), name.alias("filename"))

    return _with(F.trim(F.coalesce(c, F.lit(""))), lambda text: _with(F.lower(text), lambda low: _with(_media_type(low, marked), lambda kind: typed(text, low, kind))))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; 0 where a side doesn't vary."""
    spread = F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0)))
    return F.coalesce(F.try_divide(n * sxy - sx * sy, spread), F.lit(0.0))
