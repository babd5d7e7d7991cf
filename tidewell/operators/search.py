"""Faceted, phrase and similarity search over events."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import emoji_matches, html_escape, url_matches

DIMENSIONS = 384
_TOKEN = re.compile(r"\w+")


def fnv1a(text: str, seed: int) -> int:
    """The signed 32-bit FNV-1a hash over UTF-16 units, with a seed in its offset."""
    h = 0x811C9DC5 ^ seed
    for unit in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def embedding(text: str | None) -> list[float]:
    """A text's unit vector: each token at two hashed places, its three-letter parts at one; zero without tokens."""
    v = np.zeros(DIMENSIONS)
    weight = 1 + math.log(2)
    for token in _TOKEN.findall((text or "").lower().strip()):
        places = [(token, 0, weight), (token, 1, 0.7 * weight)]
        if len(token) >= 4:
            places += [(token[j : j + 3], 2, 0.35) for j in range(len(token) - 2)]
        for part, seed, w in places:
            h = fnv1a(part, seed)
            v[abs(h) % DIMENSIONS] += w if h >= 0 else -w
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


def _hashes(units: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Signed 32-bit FNV-1a hashes of the rows of a table of UTF-16 units."""
    h = np.full(len(units), 0x811C9DC5 ^ seed, np.uint32)
    for j in range(units.shape[1]):
        h = np.where(j < length, (h ^ units[:, j]) * np.uint32(0x01000193), h)
    return h.view(np.int32).astype(np.int64)


class _Places:
    """Where each token adds what to a vector: places and weights in flat arrays, by the token's number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.place, self.weight, self.start = np.zeros(1 << 16, np.int16), np.zeros(1 << 16), np.zeros(1 << 13, np.int64)

    def add(self, tokens: list[str]) -> None:
        """Numbers new tokens; their hashes are taken for all of a length at once."""
        by_length: dict[int, list[str]] = {}
        for t in tokens:
            by_length.setdefault(len(t), []).append(t)
        places, weights, sizes, known = [], [], [], len(self.number)
        whole = 1 + math.log(2)
        for n, group in by_length.items():
            for t in group:
                self.number[t] = len(self.number)
            points = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(-1, n)
            h, w = [], []
            if points.max() > 0xFFFF:  # some characters take two units
                for t in group:
                    parts = [(t, 0, whole), (t, 1, 0.7 * whole)] + [(t[j : j + 3], 2, 0.35) for j in range(n - 2) if n >= 4]
                    h.append([fnv1a(part, seed) for part, seed, _ in parts])
                    w.append([x for _, _, x in parts])
                h, w = np.array(h, np.int64), np.array(w)
            else:
                full = np.full(len(group), n)
                h = [_hashes(points, full, 0), _hashes(points, full, 1)] + [_hashes(points[:, j : j + 3], np.full(len(group), 3), 2) for j in range(n - 2) if n >= 4]
                h = np.stack(h, axis=1)
                w = np.broadcast_to(np.array([whole, 0.7 * whole] + [0.35] * (h.shape[1] - 2)), h.shape)
            places.append((np.abs(h) % DIMENSIONS).astype(np.int16).ravel())
            weights.append(np.where(h >= 0, w, -w).ravel())
            sizes.append(np.full(len(group), h.shape[1]))
        if sizes:
            ends = self.start[known] + np.cumsum(np.concatenate(sizes))
            self.start = _with_room(self.start, known + 1, ends)
            self.place, self.weight = (_with_room(own, self.start[known], np.concatenate(new)) for own, new in ((self.place, places), (self.weight, weights)))


def _with_room(own: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``own`` with new values from a place on, at least twice as long where they don't fit, so that it is seldom copied."""
    if at + len(new) > len(own):
        own = np.concatenate([own[:at], np.zeros(max(len(own), at + len(new)), own.dtype)])
    own[at : at + len(new)] = new
    return own


#: Distinct tokens that a process keeps places for.
KEPT_TOKENS = 400_000
_places: list[_Places] = []


def embeddings(texts: Iterable[str | None]) -> np.ndarray:
    """The vectors of texts, as ``embedding`` gives them: each distinct token is hashed once, and sums are taken by numpy."""
    if not _places or len(_places[0].number) > KEPT_TOKENS:
        _places[:] = [_Places()]
    kept, counts = _places[0], [Counter(_TOKEN.findall((t or "").lower().strip())) for t in texts]
    tokens = list(chain.from_iterable(counts))
    at = list(map(kept.number.get, tokens))
    missing = [i for i, x in enumerate(at) if x is None]
    if missing:
        kept.add(list(dict.fromkeys(tokens[i] for i in missing)))
        for i in missing:
            at[i] = kept.number[tokens[i]]
    at, ends = np.array(at, np.int64), np.cumsum([len(c) for c in counts], dtype=np.int64)
    times = np.fromiter(chain.from_iterable(c.values() for c in counts), np.float64, len(at))
    out = np.zeros((len(counts), DIMENSIONS))
    for lo in range(0, len(counts), 50):  # arrays of a few texts stay in the processor's cache
        own = slice(ends[lo - 1] if lo else 0, ends[min(lo + 50, len(counts)) - 1])
        n = kept.start[at[own] + 1] - kept.start[at[own]]
        spots = np.repeat(kept.start[at[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(counts[lo : lo + 50])) * DIMENSIONS, [len(c) for c in counts[lo : lo + 50]]), n)
        sums = np.bincount(row + kept.place[spots], weights=kept.weight[spots] * np.repeat(times[own], n), minlength=len(counts[lo : lo + 50]) * DIMENSIONS)
        out[lo : lo + 50] = sums.reshape(-1, DIMENSIONS)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


#: Distinct texts that become Python strings, and vectors, at a time.
HELD_TEXTS = 500


def _made(text: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch's distinct texts, in single precision, HELD_TEXTS at a time."""
    for lo in range(0, len(text), HELD_TEXTS):
        yield embeddings(text[lo : lo + HELD_TEXTS].to_pylist()).astype(np.float32)


@F.arrow_udf(ArrayType(FloatType()))
def embed(text: pa.Array) -> pa.Array:
    """The vectors of a column of texts; each distinct text of a batch is embedded once."""
    coded = text.dictionary_encode(null_encoding="encode")
    made = np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *_made(coded.dictionary)])[coded.indices.to_numpy()]
    return pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * DIMENSIONS, made.ravel())


def similarity(text: Column, query: str) -> Column:
    """``cosine01`` of the texts' vectors and the query's; only the number leaves Python."""
    asked = np.array(embedding(query))

    @F.arrow_udf("double")
    def dots(text: pa.Array) -> pa.Array:
        coded = text.dictionary_encode(null_encoding="encode")
        # Summed from left to right, as cosine01 does.
        found = [np.add.accumulate(v * asked, axis=1)[:, -1] for v in _made(coded.dictionary)]
        return pa.array(np.concatenate([np.zeros(0), *found])[coded.indices.to_numpy()])

    return _moved(dots(text))


def _moved(dot: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2))


def cosine01(a: Column, b: Column) -> Column:
    """The dot product of unit vectors, moved from -1..1 to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return _moved(dot)


def relevance(c: Column, words: Iterable[str] = (), phrases: Iterable[str] = ()) -> Column:
    """1, and 10 for each phrase, 2 for each word contained, 3 more if the text starts with it."""
    low, score = F.lower(c), F.lit(1.0)
    for p in phrases:
        score = score + F.when(F.contains(low, F.lit(p.lower())), 10.0).otherwise(0.0)
    for w in words:
        hit = F.contains(low, F.lit(w.lower()))
        score = score + F.when(hit, 2.0).otherwise(0.0) + F.when(low.startswith(w.lower()), 3.0).otherwise(0.0)
    return score


def snippet(c: Column, terms: Iterable[str], width: int = 160, before: int = 40) -> Column:
    """The text around the first term, HTML-escaped, with each term in <mark>."""
    terms = [t for t in terms if t]
    if not terms:
        return html_escape(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c))
    spots = F.filter(F.array(*[F.locate(t.lower(), F.lower(c)) for t in terms]), lambda x: x > 0)
    first = F.array_min(spots) - 1
    start = F.when(first.isNotNull() & (F.length(c) > width), F.greatest(F.lit(0), first - before)).otherwise(F.lit(0))
    end = F.when(first.isNotNull() & (F.length(c) > width), F.least(F.length(c), start + width)).otherwise(F.length(c))
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), c.substr(start + 1, end - start), F.when(end < F.length(c), F.lit("...")).otherwise(F.lit("")))
    out = html_escape(cut)
    for t in terms:
        safe = t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")
        out = F.regexp_replace(out, f"(?i)({re.escape(safe)})", "<mark>$1</mark>")
    return out


def filter_events(ev: DataFrame, start=None, end=None, actors: Iterable[str] | None = None, contains: str | None = None, datasets: Iterable[str] | None = None, has_urls: bool | None = None, has_media: bool | None = None, has_emojis: bool | None = None) -> DataFrame:
    """Events within inclusive times, of some actors and datasets, with a text in them, ignoring case, and with or without links, media, emojis."""
    if datasets is not None:
        ev = ev.where(F.col("dataset_id").isin(list(datasets)))
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(start).cast(ev.schema["ts"].dataType))
    if end is not None:
        ev = ev.where(F.col("ts") <= F.lit(end).cast(ev.schema["ts"].dataType))
    if actors is not None:
        ev = ev.where(F.col("actor").isin(list(actors)))
    if contains:
        ev = ev.where(F.contains(F.lower("content"), F.lit(contains.lower())))
    own = {"has_urls": F.size(url_matches(F.col("content"))) > 0, "has_emojis": F.size(emoji_matches(F.col("content"))) > 0, "has_media": F.lit(False)}
    for flag, wanted in (("has_urls", has_urls), ("has_media", has_media), ("has_emojis", has_emojis)):
        if wanted is not None:
            ev = ev.where((F.col(flag) if flag in ev.columns else own[flag]) == wanted)
    return ev


def search(
    ev: DataFrame, text: str = "", phrases: Iterable[str] = (), emojis: Iterable[str] = (), mode: str = "exact", order: str = "relevance", page: int = 1, limit: int = 20, candidate_limit: int | None = None, with_total: bool = False, **facets
) -> DataFrame:
    """A page of events with score, similarity and snippet, and ``with_total`` the number of all matches as total.

    ``exact`` keeps events with all words, phrases and emojis and ranks by
    relevance; ``hybrid`` keeps those with all phrases and emojis and ranks by
    0.6 of similarity and 0.4 of relevance; ``semantic`` keeps all and ranks by
    similarity. Ranking is over all events that are kept, or over the newest
    ``candidate_limit``.
    """
    words, phrases, emojis = text.split(), list(phrases), list(emojis)
    hit = filter_events(ev, **facets)
    low = F.lower("content")
    for t in (words if mode == "exact" else []) + (phrases + emojis if mode != "semantic" else []):
        hit = hit.where(F.contains(low, F.lit(t.lower())))
    if candidate_limit:
        hit = hit.orderBy(F.desc("ts"), "id").limit(candidate_limit)
    total = hit.agg(F.count(F.lit(1)).alias("n")) if with_total else None
    rel = relevance(F.col("content"), words, phrases)
    if mode == "exact":
        scored = hit.withColumns({"similarity": F.lit(None).cast("double"), "score": rel})
    else:
        scored = hit.withColumn("similarity", similarity(F.col("content"), " ".join([text, *phrases])))
        scored = scored.withColumn("score", F.col("similarity") * 100 if mode == "semantic" else 0.6 * (F.col("similarity") * 50) + 0.4 * rel)
    by = {"relevance": [F.desc("score"), F.desc("ts"), F.asc("id")], "newest": [F.desc("ts"), F.asc("id")], "oldest": [F.asc("ts"), F.asc("id")]}[order]
    n = max(1, min(limit, 100))
    shown = scored.orderBy(*by).offset((max(page, 1) - 1) * n).limit(n).withColumn("snippet", snippet(F.col("content"), [*phrases, *words, *emojis]))
    return shown if total is None else shown.withColumn("total", total.scalar())


def page_events(ev: DataFrame, after: tuple | None = None, limit: int = 50, desc: bool = False, with_total: bool = False) -> DataFrame:
    """The events after a cursor (ts, id), one more than ``limit`` (1 to 100) if there are more; ``with_total`` adds the number of all events as total."""
    n = max(1, min(limit, 100))
    if with_total:
        ev = ev.withColumn("total", ev.agg(F.count(F.lit(1))).scalar())
    if after is not None:
        at, cursor = F.struct("ts", "id"), F.struct(F.lit(after[0]).cast(ev.schema["ts"].dataType).alias("ts"), F.lit(after[1]).cast(ev.schema["id"].dataType).alias("id"))
        ev = ev.where(at < cursor if desc else at > cursor)
    return ev.orderBy(*([F.desc("ts"), F.desc("id")] if desc else [F.asc("ts"), F.asc("id")])).limit(n + 1)


def first_occurrence(ev: DataFrame, keyword: str) -> DataFrame:
    """The first event of each dataset with a keyword, and how many have it."""
    hit = ev.where(F.contains(F.lower("content"), F.lit(keyword.lower())))
    return hit.groupBy("dataset_id").agg(F.min(F.struct("ts", "id", "actor")).alias("f"), F.count(F.lit(1)).alias("occurrences")).select("dataset_id", "f.id", "f.ts", "f.actor", "occurrences")


def random_event(ev: DataFrame, seed: int = 0) -> DataFrame:
    """One event of each dataset that the seed picks."""
    w = Window.partitionBy("dataset_id").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"))), "id")
    return ev.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _blocks(df: DataFrame, size: int, id_col: str, col: str, name: str) -> DataFrame:
    """Rows of a vector table in blocks of about ``size``: arrays of identifiers and vectors."""
    n = max(1, -(-df.count() // size))
    rows = df.where(F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(col).cast("array<float>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_b"))
    return rows.groupBy("_b").agg(F.collect_list("i").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vectors")).drop("_b")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", col: str = "embedding", block: int = 2048) -> DataFrame:
    """The ``k`` vectors most similar to each query vector, itself left out: query, id, similarity, rank.

    Blocks of queries meet blocks of vectors, a matrix product each; a pair of
    blocks leaves k candidates a query. Null vectors are left out.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(frames):
        for f in frames:
            for ids, vs, at, qs in zip(f["v_ids"], f["v_vectors"], f["q_ids"], f["q_vectors"]):
                ids, at = np.asarray(ids), np.asarray(at)
                s = unit(np.stack(qs).astype(np.float64)) @ unit(np.stack(vs).astype(np.float64)).T
                s[at[:, None] == ids[None, :]] = -np.inf
                n = min(k, len(ids))
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield pd.DataFrame({"query": np.repeat(at, n), "id": ids[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})

    pairs = _blocks(vectors, block, id_col, col, "v").crossJoin(_blocks(queries, block, id_col, col, "q"))
    near = pairs.mapInPandas(run, "query long, id long, similarity double").where(F.col("similarity") >= -2)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("id"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
