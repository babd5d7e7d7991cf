"""Finds benchmark items in documents by a prefix-filtered set join.

An item's windows are its runs of 13 words (a shorter item is one window). A
window is a set of three-word shingles; a text that holds the window holds all
of them, so its rarest one is a necessary prefix of length one. Documents are
joined with windows on that shingle alone. The shingle's place in the window
bounds where the window must lie in the document; then its words are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, bloom_bits, bloom_of, in_arrow, in_bloom, materialize, shingles, word_hashes

WINDOW, WIDTH = 13, 3
_WINDOWS = "item_id string, words binary, n int, at int, shingle long"
_FOUND = "doc_id long, text_key long, n_words long, own boolean, shingle long, spot int, first int, around binary"


def item_windows(items: DataFrame, window: int = WINDOW, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each window's shingles: item_id (as string), words (joined by spaces), n words, at (the shingle's first word), shingle."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches):
        hashes = word_hashes(NOT_ALNUM)
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, first, last, raw = hashes.places(text)
                words = [raw[i:j].lower() for i, j in zip(first.tolist(), last.tolist())]
                n = min(window, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    own = b" ".join(words[i : i + n])
                    for at, s in enumerate(shingles(h[i : i + n], width).view(np.int64).tolist()):
                        out.append((item, own, n, at, s))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "words", "n", "at", "shingle"])

    return in_arrow(rows, cut, _WINDOWS)


def prefixes(docs: DataFrame, windows: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """Each distinct window with its rarest shingle: words, n, at, shingle, and the items that have the window.

    Rarity is the shingle's count in all documents. A Bloom filter
    lets tasks count only shingles that some window has.
    """
    # A window of fewer words than a shingle is one short shingle; its length is part of its hash.
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(width)).alias("k")).distinct().collect())
    bitmap = bloom_of(windows, "shingle", bloom_bits(windows.count()))

    def count(batches):
        hashes = word_hashes(NOT_ALNUM)
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                h = hashes(text)
                for k in lengths:
                    if len(h) >= k:
                        s = shingles(h, k)
                        found.append(s[in_bloom(bitmap, s)])
            s, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["_s", "k"])

    counts = in_arrow(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), count, "_s long, k long").groupBy("_s").agg(F.sum("k").alias("k"))
    rare = windows.join(counts, windows["shingle"] == counts["_s"])
    best = rare.select("item_id", "words", "n", "at", "shingle", "k").groupBy("words", "n").agg(F.min(F.struct("k", "shingle", "at")).alias("best"), F.collect_set("item_id").alias("items"))
    return best.select("words", "n", "best.at", "best.shingle", "items")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document's row, and one for each place of a window in it.

    Columns: doc_id, text_key (a hash of the text), n_words, items (that have the
    window; null in a document's own row), start (the window's first word), n.
    A window's shingle that no document has drops the window; then no document
    can hold it.
    """
    windows = materialize(item_windows(items, window, width), "windows")
    prefix = materialize(prefixes(docs, windows, width, text_col), "prefixes")
    lengths = sorted(r[0] for r in prefix.select(F.least("n", F.lit(width)).alias("k")).distinct().collect())
    bitmap = bloom_of(prefix, "shingle", bloom_bits(prefix.count()))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def scan(batches):
        hashes = word_hashes(NOT_ALNUM)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in batches:
            out, held = [], 0
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, starts, ends, raw = hashes.places(text)
                out.append((doc_id, key, len(h), True, hash((doc_id, key)), None, None, None))
                for k in lengths:
                    if len(h) < k:
                        continue
                    s = shingles(h, k)
                    for i in np.flatnonzero(in_bloom(bitmap, s)).tolist():
                        first = max(0, i - window + 1)
                        around = b" ".join(raw[a:b].lower() for a, b in zip(starts[first : i + window].tolist(), ends[first : i + window].tolist()))
                        out.append((doc_id, key, len(h), False, int(s[i].astype(np.int64)), i, first, around))
                        held += len(around) + 64
                if held > 4 << 20 or len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    found = in_arrow(rows, scan, _FOUND)
    p = prefix.select(F.col("shingle").alias("_s"), F.lit(False).alias("_o"), "words", "n", "at", "items")
    # A document's own row meets no window and is kept by the left join; its key only
    # spreads such rows. Length and position: the window starts ``at`` words before
    # the shingle and ends in the text.
    start = F.col("spot") - F.col("at")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    cut = F.split(F.col("around").cast("string"), " ")
    same = F.array_join(F.slice(cut, start - F.col("first") + 1, F.greatest("n", F.lit(1))), " ").cast("binary") == F.col("words")
    met = found.join(p, (F.col("shingle") == F.col("_s")) & (F.col("own") == F.col("_o")), "left").where(F.col("own") | F.when(inside, same).otherwise(False))
    return met.select("doc_id", "text_key", "n_words", "items", start.alias("start"), "n")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_key, n_words, n_hit, items (sorted strings).

    n_hit counts the words inside any occurrence of a window; items are those
    that have a window there. Verified places are shuffled by (identifier, hash
    of the text), so copies of a text don't meet in a task. Repeated rows come
    back as often as they came; a null identifier is a value of its own. A null
    text, or one without words, has no hits, and such an item has no windows.
    """
    places = occurrences(docs, items, window, width, id_col, text_col)
    hit = F.col("items").isNotNull()
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n")),
        lambda s: s["n"].cast("long"),
    )
    return (
        places.groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(~hit, 1)).alias("copies"),
            F.array_sort(F.collect_set(F.when(hit, F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("n_hit", union)
        .withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
        .select("doc_id", "text_key", "n_words", "n_hit", "items")
    )


def contaminated() -> Column:
    """The rule: some words are hit, and they are a twentieth of all at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rule rejects."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col).where(contaminated()).select(F.col("doc_id").alias("_tw_d"), F.col("text_key").alias("_tw_k")).distinct()
    bad = materialize(bad, "contaminated")  # its size decides whether texts are shuffled
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(bad["_tw_d"]) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == bad["_tw_k"])
    return docs.join(bad, same, "left_anti")
