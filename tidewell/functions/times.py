"""Flexible reading of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = ("", " H:mm:ss", " H:mm", " h:mm:ss a", " h:mm a", ", H:mm:ss", ", H:mm", ", h:mm:ss a", ", h:mm a")


def _first(c: Column, dates: list[str]) -> Column:
    up = F.upper(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(up, F.lit(d + t)) for d in dates for t in _CLOCK])


def parse_ts(c: Column, dayfirst: bool = False) -> Column:
    """A time from text, or null: ISO and slashed dates, months by name, seconds or milliseconds since 1970.

    A slashed date's first part is the day if ``dayfirst`` or if it can't be a
    month; otherwise it is the month, unless the second part can't be a day.
    """
    s = F.trim(c.cast("string"))
    native = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s))
    day, month = ["d/M/yyyy", "d/M/yy"], ["M/d/yyyy", "M/d/yy"]
    slashed = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), _first(s, [day[0]] if dayfirst else [month[0], day[0]])).when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}([, ]|$)"), _first(s, [day[1]] if dayfirst else [month[1], day[1]]))
    other = F.when(s.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"), _first(F.regexp_replace(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1-$2-$3"), ["yyyy-M-d"]))
    named = F.when(s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}\D"), _named(s, "d-MMM-yy")).when(s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}"), _named(s, "d-MMM-yyyy")).when(s.rlike(r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"), _named(F.regexp_replace(s, r"^([A-Za-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})", "$1 $2 $3"), "MMM d yyyy"))
    number = s.try_cast("bigint")
    epoch = F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(number)).when(s.rlike(r"^\d{11,13}$"), F.timestamp_millis(number))
    return F.coalesce(native, slashed, other, named, epoch)


def _named(s: Column, date: str) -> Column:
    # Month names are read in title case, and AM or PM in capitals.
    month = F.regexp_extract(s, r"([A-Za-z]{3})", 1)
    tidy = F.concat(F.regexp_extract(s, r"^(\d{1,2}-|)", 1), F.initcap(F.lower(month)), F.upper(F.regexp_replace(F.regexp_replace(s, r"^(\d{1,2}-|)[A-Za-z]{3}", ""), r"\s+", " ")))
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(date + t)) for t in _CLOCK])
