"""URL filters: rules by host and path, and exact membership in large lists by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for those, and so
on until no key is left. A key's first level that doesn't hold it tells which
side it is on; since the levels were made over all keys that are ever asked for,
the answer is exact. Pages are asked in place: no join and no shuffle of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_names, lower_ascii, materialize

#: Hashes a key at level 1 and at later ones: shares of about 1/128 and 1/4 pass by chance.
FIRST_HASHES, LATER_HASHES = 7, 2
#: Bits of one cascade that tasks hold at most (16 MB); longer lists are split into several, asked in turn.
MAX_BITS = 1 << 27
#: Words of 64 bits that a row holds while a filter is put together.
_CHUNK = 1024
#: The columns that judge adds.
ADDED = ["host", "path", "rule", "listed", "verdict"]


@dataclass
class Level:
    offset: int  # its first bit in the cascade's array
    bits: int
    hashes: int
    salt: int


@dataclass
class Cascade:
    """Levels over one array of words, kept as a one-row table (words)."""

    levels: list[Level] = field(default_factory=list)
    table: DataFrame | None = None

    def holds(self, key: Column) -> Column:
        """Whether a key of the cascade's universe is listed; false for null."""
        if not self.levels:
            return F.lit(False)
        words = self.table.scalar()
        verdict = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels), 0, -1):
            verdict = F.when(_in_level(words, self.levels[at - 1], key), verdict).otherwise(F.lit(at % 2 == 0))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def _spots(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.salt), F.lit(j), key), F.lit(level.bits).cast("long")) + F.lit(level.offset).cast("long") for j in range(level.hashes)]


def _in_level(words: Column, level: Level, key: Column) -> Column:
    found = F.lit(True)
    for spot in _spots(key, level):
        word = F.get(words, F.shiftright(spot, 6).cast("int"))
        found = found & (F.getbit(word, (spot % 64).cast("int")) == 1)
    return found


def _filled(keys: DataFrame, level: Level) -> DataFrame:
    """A level's words as rows (chunk, words) of _CHUNK words each, numbered within the level."""
    own = Level(0, level.bits, level.hashes, level.salt)
    n_words = -(-level.bits // 64)
    set_bits = keys.select(F.explode(F.array(*_spots(F.col("key"), own))).alias("spot")).select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("word"))
    every = keys.sparkSession.range(n_words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    merged = set_bits.unionByName(every).groupBy("at").agg(F.bit_or("word").alias("word"))
    chunk = merged.groupBy(F.floor(F.col("at") / _CHUNK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return chunk.select("chunk", F.transform("w", lambda x: x["word"]).alias("words"))


def _joined(chunks: DataFrame, label: str) -> DataFrame:
    """The chunks in order as one array in one row, written once. MAX_BITS bounds it."""
    row = chunks.agg(F.array_sort(F.collect_list(F.struct("chunk", "words"))).alias("c"))
    return materialize(row.select(F.flatten(F.transform("c", lambda x: x["words"])).alias("words")), label)


def _level_bits(n: int, hashes: int) -> int:
    return 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> Cascade:
    """A cascade of the keys ``listed`` (key) that is exact over the keys of ``universe`` (key, repeats allowed).

    Only keys that level 1 lets through are shuffled, not the universe. Null
    keys are left out; an empty list gives a cascade that holds nothing.
    """
    inside = materialize(listed.select("key").where("key is not null").distinct(), "cascade-listed")
    levels, chunks, n = [], [], inside.count()
    hashes, other, n_other, offset = FIRST_HASHES, None, None, 0
    while n:
        level = Level(0, _level_bits(n, hashes), hashes, salt * 1000 + len(levels))
        part = materialize(_filled(inside, level), "cascade-level")
        chunks.append(part.withColumn("chunk", F.col("chunk") + len(chunks) * (1 << 32)))
        words = _joined(part, "cascade-words").scalar()
        if other is None:
            met = universe.select("key").where("key is not null").where(_in_level(words, level, F.col("key"))).distinct()
            both = met.withColumn("listed", F.lit(0)).unionByName(inside.withColumn("listed", F.lit(1))).groupBy("key").agg(F.max("listed").alias("listed"))
            passed = both.where("listed = 0").select("key")
        else:
            passed = other.where(_in_level(words, level, F.col("key")))
        passed = materialize(passed, "cascade-passed")
        levels.append(Level(offset, level.bits, level.hashes, level.salt))
        offset += level.bits
        # The wrongly passed keys are encoded next, and those just encoded must then be told from them.
        inside, other, n, hashes = passed, inside, passed.count(), LATER_HASHES
    if not levels:
        return Cascade()
    return Cascade(levels, _joined(reduce(DataFrame.unionByName, chunks), "cascade"))


def expected_bits(n: int) -> int:
    """About the bits of a cascade of n keys in a universe of up to 128 times as many others."""
    return math.ceil(n * (FIRST_HASHES + 3 * LATER_HASHES) / math.log(2))


def cascades_of(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Cascade]:
    """Cascades for a list of any length: each holds the keys of one hash remainder and has ``max_bits`` at most, by expectation."""
    pieces = max(1, -(-expected_bits(listed.count()) // max_bits))
    own = lambda df, p: df if pieces == 1 else df.where(_piece(F.col("key"), pieces) == p)
    return [build_cascade(own(listed, p), own(universe, p), salt=p + 1) for p in range(pieces)]


def _piece(key: Column, pieces: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(pieces)).cast("int")


# ---------------------------------------------------------------- urls


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column, labels: Iterable[int]) -> list[Column]:
    """The host's suffixes of these numbers of labels as keys; null where it has fewer."""
    cut = F.split(host, r"\.")
    return [F.when((host != "") & (F.size(cut) >= n), F.concat(F.lit("host "), F.array_join(F.slice(cut, -n, n), "."))) for n in labels]


def page_key(host: Column, path: Column) -> Column:
    """A page's own key: host and path; null without a host."""
    return F.when(host != "", F.concat(F.lit("page "), host, path))


Rule = tuple[str, str, str]


def matching_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """struct(name, verdict) of the longest rule (verdict, host, path) that fits a host, or a domain above it, and its path's beginning; null for none.

    Of rules as long the one with the longer host comes first, then by name.
    """
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: Iterable[Rule], url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Adds host, path, rule, listed and verdict (allow or block) to pages.

    ``listed`` has columns host and path: a null path lists a host with all its
    subdomains, any other one page. A rule's verdict comes first; without one a
    listed url is blocked, any other allowed. Lists of any length work: a longer
    one is split by hash, and pages are written between the parts' cascades, so
    tasks hold ``max_bits`` at a time.

    A null url, or one without ://, has an empty host and path and is allowed;
    null hosts in the list list nothing. Repeated pages are judged alike, and no
    pages give none. The caller's columns stay; one named as an added column
    gets ``_given``.
    """
    own = pages.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(pages.columns, given_names(pages.columns, [*ADDED, "_hit"]))], host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    given = listed.where("host is not null and host <> ''").select(lower_ascii(F.col("host")).alias("host"), "path")
    keys = materialize(given.select(F.when(F.col("path").isNull(), F.concat(F.lit("host "), "host")).otherwise(page_key(F.col("host"), F.col("path"))).alias("key"), F.when(F.col("path").isNull(), F.size(F.split("host", r"\."))).alias("labels")).distinct(), "url-list")
    labels = sorted(r["labels"] for r in keys.where("labels is not null").select("labels").distinct().collect())  # numbers of labels: a few
    asked = [*host_keys(F.col("host"), labels), page_key(F.col("host"), F.col("path"))]
    universe = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")).select(F.explode(F.array(*asked)).alias("key"))
    cascades = cascades_of(keys.select("key"), universe, max_bits)
    pieces, hit = len(cascades), F.lit(False)
    for p, cascade in enumerate(cascades):
        for key in asked:
            hit = hit | cascade.holds(key if pieces == 1 else F.when(_piece(key, pieces) == p, key))
        if p < pieces - 1:
            own = materialize(own.withColumn("_hit", hit), "url-asked")
            hit = F.col("_hit")
    judged = own.withColumn("listed", hit).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).drop("_hit")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("*", F.col("_rule.name").alias("rule"), verdict.alias("verdict")).drop("_rule")
