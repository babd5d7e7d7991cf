"""Documents and tables: topics, statistics, similarity, column profiles, gradebooks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STOP_WORDS
from ..functions.text import date_matches, found, remove_stop_words
from ..functions.times import parse_ts
from ..shared import materialize


def document_tokens(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Adds tokens: ASCII words of three signs and more, lower-cased, without stop words."""
    return docs.withColumn("tokens", remove_stop_words(found(F.lower("text"), r"[a-z0-9_]{3,}"), stop_words))


def document_topics(docs: DataFrame, k: int = 10) -> DataFrame:
    """Tokens by the number of documents that have them."""
    terms = document_tokens(docs).select(F.explode(F.array_distinct("tokens")).alias("token"))
    return terms.groupBy("token").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), F.asc("token")).limit(k)


def document_stats(docs: DataFrame, id_col: str = "doc_id", dates: int = 20, page_chars: int = 3000) -> DataFrame:
    """Filtered words, pages of ``page_chars`` and the first dates of each document."""
    return document_tokens(docs).select(
        id_col,
        F.size("tokens").cast("long").alias("words"),
        F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / page_chars)).cast("long").alias("pages"),
        F.slice(date_matches(F.col("text")), 1, dates).alias("dates"),
    )


def document_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.sum("pages").alias("pages"))


#: Words of 64 bits in a document's sketch, and index rows of a token and size beyond which they are split.
SKETCH_WORDS, HOT_ROWS = 32, 1024
#: From this percent on, pairs are found by their rarest tokens; below it, where most sets share one of these, by blocks of sketches.
PREFIX_PERCENT = 90
#: Below this percent common tokens are counted for all pairs of two blocks; from it on, pairs are screened by sketches.
COUNT_PERCENT = 20
#: Documents of equal sets that are compared as one; matches and cells of pairs that are counted at once; pairs put out at once.
COPIES, MATCHES, PAIRS = 16, 1 << 22, 1 << 19
#: Blocks that nodes are dealt to; a block's nodes at least and at most, and its sketches' bytes at most; nodes and bytes of sketches in one matrix product.
BLOCKS, BLOCK_NODES, BLOCK_BYTES, TILE, TILE_BYTES = 24, (512, 16_384), 1 << 26, 1024, 512


def _sketch(token: str) -> list[Column]:
    """The parity of a set's tokens in SKETCH_WORDS words, as aggregates: two sketches never differ in more bits than their sets do in tokens."""
    h = F.xxhash64(token)
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(SKETCH_WORDS)), F.expr(f"shiftleft(1L, cast(xxhash64({token}) & 63 as int))")
    return [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(SKETCH_WORDS)]


def _near_by_prefixes(toks: DataFrame, p: int) -> DataFrame:
    """Pairs (a, b) that sketches don't rule out, of sets (rows id, token, df) that may be as similar.

    Of two sets the smaller one is found by its rarest tokens, so few that the
    other must have one of them among its own rarest. A token's rows are split
    by size, and by hash where they are many, so a hot token is many tasks.
    """
    w = Window.partitionBy("id")
    ranked = toks.withColumns({"n": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy("df", "token"))})
    # Whole numbers throughout: a share of n * 0.07 rounds above 7 for n = 100.
    least = {"x": f"rank <= n - (2 * {p} * n + {99 + p}) div {100 + p} + 1", "y": f"rank <= n - (n * {p} + 99) div 100 + 1"}
    rows = materialize(ranked.where(least["y"]).select("id", "token", "n", "rank", F.length(F.bin("n")).alias("size")), "prefixes")
    index = rows.where(least["x"])
    hot = index.groupBy("token", "size").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_ROWS)
    hot = materialize(hot.select(F.col("token").alias("_t"), F.col("size").alias("_s"), F.ceil(F.col("k") / HOT_ROWS).cast("int").alias("splits")), "hot-tokens")
    split = lambda df, size: df.join(hot, (F.col("token") == F.col("_t")) & (F.col(size) == F.col("_s")), "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    x = split(index, "size").select("id", "token", "n", "rank", "size", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("part"))
    # A set as similar has at least p hundredths of the tokens, so its size in bits is among the next lower ones.
    reach = next(j for j in range(1, 8) if p << j >= 100)
    y = rows.withColumn("sought", F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - reach), F.col("size"))))
    y = split(y, "sought").select("id", "token", "n", "rank", "sought", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
    # By length, and by position: the tokens before this one, it, and those after it must suffice.
    near = f"""x.token = y.token and x.size = y.sought and x.part = y.part and (x.n < y.n or x.n = y.n and x.id < y.id) and x.n * 100 >= {p} * y.n
      and (least(x.n - x.rank, y.n - y.rank) + least(x.rank, y.rank)) * {100 + p} >= {p} * (x.n + y.n)"""
    pairs = x.alias("x").join(y.alias("y"), F.expr(near)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    sketches = materialize(toks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *_sketch("token")), "sketches")
    side = lambda k: sketches.select(F.col("id").alias(f"_{k}"), *[F.col(c).alias(f"{k}_{c}") for c in sketches.columns[1:]])
    apart = reduce(lambda s, t: s + t, [F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(SKETCH_WORDS)])
    met = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return met.where(apart * (100 + p) <= (F.col("a_n") + F.col("b_n")) * (100 - p)).select("a", "b")


def _similar_nodes(toks: DataFrame, min_percent: int) -> DataFrame:
    """(a, b, k, u) of nodes whose sets (rows id, token, df) are as similar: a < b, common tokens, all tokens. Candidates are screened by sketches before their sets meet."""
    p = min_percent
    close = materialize(_near_by_prefixes(toks, p) if p >= PREFIX_PERCENT else _near_by_blocks(toks, p), "close")
    needed = close.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    sets = materialize(toks.join(needed, F.col("id") == F.col("_n"), "left_semi").groupBy("id").agg(F.collect_list("token").alias("set")), "sets")
    of = lambda k: sets.select(F.col("id").alias(f"_{k}"), F.col("set").alias(f"s{k}"))
    both = F.size(F.array_intersect("sa", "sb"))
    full = close.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select("a", "b", both.alias("k"), (F.size("sa") + F.size("sb")).alias("u"))
    return full.select("a", "b", "k", (F.col("u") - F.col("k")).alias("u")).where(F.col("k") * 100 >= F.col("u") * p)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's size and the parity of its hashed tokens in four bits a token or more, a power of two."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends, out = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), []
        for lo, hi in zip(ends, ends[1:]):
            bits = max(64, 1 << (4 * int(hi - lo) - 1).bit_length())
            out.append(np.packbits(np.bincount(flat[lo:hi] & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(out, pa.binary())], names=["id", "n", "sketch"])


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches in ``size`` bytes each: equal parts are laid on each other."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size)) for x in sketches])


def _kind() -> Column:
    return F.floor(2 * F.log2("n")).cast("int")


def _sent_by_blocks(nodes: DataFrame, deal: Column, size: Column, p: int) -> DataFrame:
    """Nodes (n, kind, more) with pair, alone and block: blocks of nodes of like sizes are sent to each pair of blocks that may hold sets as similar; ``deal`` is a node's hash, ``size`` its bytes."""
    facts = sorted(nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.max(size).alias("size")).collect())  # a row for each half power of two
    share = min(max(-(-sum(f["k"] for f in facts) // BLOCKS), BLOCK_NODES[0]), BLOCK_NODES[1])
    blocks, dealt = [], {}
    for f in facts:
        dealt[f["kind"]] = (len(blocks), -(-f["k"] // max(1, min(share, BLOCK_BYTES // f["size"]))))
        blocks += [f] * dealt[f["kind"]][1]
    met = [(i, j) for j, y in enumerate(blocks) for i, x in enumerate(blocks[: j + 1]) if 100 * x["n2"] >= p * y["n1"]]
    sides = nodes.sparkSession.createDataFrame([(b, pair, i == j) for pair, (i, j) in enumerate(met) for b in {i, j}], "_block int, pair int, alone boolean")
    places = nodes.sparkSession.createDataFrame([(kind, *at) for kind, at in dealt.items()], "_kind int, first int, parts int")
    placed = nodes.join(places, F.col("kind") == F.col("_kind")).withColumn("block", (F.col("first") + F.pmod(deal, F.col("parts"))).cast("int"))
    return placed.join(sides, F.col("block") == F.col("_block")).select("pair", "alone", "block", *[c for c in nodes.columns if c != "kind"])


def _near_by_blocks(toks: DataFrame, p: int) -> DataFrame:
    """Pairs (a, b) that sketches and sizes don't rule out, each once: blocks of nodes of like sizes meet in tasks that compare all sketches by matrix products.

    A node is sent once for each block that its own meets, so what is shuffled
    doesn't grow with the pairs compared, and only pairs that are left are
    written. Blocks have BLOCK_NODES nodes at most, more than BLOCKS of them
    only where nodes are that many.
    """
    key = dict((f.name, f.dataType.simpleString()) for f in toks.schema)["id"]
    hashed = toks.groupBy("id").agg(F.collect_list(F.xxhash64("token")).alias("set"))
    nodes = materialize(hashed.mapInArrow(_packed, f"id {key}, n long, sketch binary").withColumn("kind", _kind()), "sketches")
    sent = _sent_by_blocks(nodes, F.xxhash64("id"), F.length("sketch"), p)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("n")
        block, n, ids, sketches = table["block"].to_numpy(), table["n"].to_numpy(), table["id"].combine_chunks(), table["sketch"].to_pylist()
        alone = table["alone"][0].as_py()
        xs, ys = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if not alone and block.min() == block.max():
            return
        for x in (xs[lo : lo + TILE] for lo in range(0, len(xs), TILE)):
            for y in (ys[lo : lo + TILE] for lo in range(0, len(ys), TILE)):
                if alone and x[0] > y[-1] or 100 * n[x[-1]] < p * n[y[0]] or 100 * n[y[-1]] < p * n[x[0]]:
                    continue
                # Sketches are sorted by size, so the first of each side is its shortest.
                size = min(len(sketches[x[0]]), len(sketches[y[0]]))
                one, other = (_folded([sketches[i] for i in side], size) for side in (x, y))
                # Equal bits less unequal ones, for all pairs at once.
                same = np.zeros((len(x), len(y)), np.float32)
                for lo in range(0, size, TILE_BYTES):
                    s, t = (np.unpackbits(m[:, lo : lo + TILE_BYTES], axis=1).astype(np.float32) * 2 - 1 for m in (one, other))
                    same += s @ t.T
                nx, ny = n[x][:, None], n[y][None, :]
                ok = ((8 * size - same) / 2 * (100 + p) <= (nx + ny) * (100 - p)) & (100 * np.minimum(nx, ny) >= p * np.maximum(nx, ny))
                i, j = np.nonzero(ok & (x[:, None] < y[None, :]) if alone else ok)
                if len(i):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[i])), ids.take(pa.array(y[j]))], names=["a", "b"])

    return sent.groupBy("pair").applyInArrow(compare, f"a {key}, b {key}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _matches(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, k) of sets of two sides that share k tokens, one at least, by stretches of i; a side is its tokens and where each set begins and ends."""
    (tokens, at), (others, ends) = x, y
    known, number = np.unique(others, return_inverse=True)
    first, ny = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(known)))]), len(ends) - 1
    holders = np.repeat(np.arange(ny), np.diff(ends))[np.argsort(number, kind="stable")]  # of each known token, in turn
    token = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hit = known[token] == tokens
    row, token = np.repeat(np.arange(len(at) - 1), np.diff(at))[hit], token[hit]
    many = first[token + 1] - first[token]
    load = np.cumsum(np.maximum(np.bincount(row, many, len(at) - 1), ny))
    lo = 0
    while lo < len(load):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + MATCHES, "right")))
        a, b = np.searchsorted(row, (lo, hi))
        k = many[a:b]
        each = np.repeat(first[token[a:b]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        counts = np.bincount(np.repeat(row[a:b] - lo, k) * ny + holders[each], minlength=(hi - lo) * ny)
        cells = np.flatnonzero(counts)
        yield lo + cells // ny, cells % ny, counts[cells]
        lo = hi


def _pairs_by_counts(members: DataFrame, first: DataFrame, toks: DataFrame, p: int) -> DataFrame:
    """(id_a, id_b, k, u) of all pairs of documents that share a token and are as similar, each once: blocks of documents meet in tasks that count common tokens.

    A document is sent once for each block that its own meets. Pairs are put
    out as they are counted and never shuffled, so disk doesn't grow with them.
    """
    key = dict((f.name, f.dataType.simpleString()) for f in members.schema)["id"]
    numbers = materialize(toks.select(F.col("token").alias("_t")).distinct().withColumn("number", F.monotonically_increasing_id()), "token-numbers")
    sets = toks.join(numbers, F.col("token") == F.col("_t")).groupBy(F.col("id").alias("_rep")).agg(F.collect_list("number").alias("set"))
    alike = members.join(first, "node").where("id is not null").groupBy("rep", F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / COPIES)).alias("chunk")).agg(F.collect_list("id").alias("ids"))
    nodes = alike.join(sets, F.col("rep") == F.col("_rep")).select("rep", "chunk", "ids", F.size("set").cast("long").alias("n"), "set").withColumn("kind", _kind())
    sent = _sent_by_blocks(materialize(nodes, "nodes"), F.xxhash64("rep", "chunk"), 8 * (F.col("n") + F.size("ids")), p).drop("rep", "chunk")

    def rows(a: pa.Array, b: pa.Array, k: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a, b, pa.array(k, pa.int64()), pa.array(u, pa.int64())], names=["a", "b", "k", "u"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        block, n, alone = table["block"].to_numpy(), table["n"].to_numpy(), table["alone"][0].as_py()
        if not alone and block.min() == block.max():
            return
        lists = {c: table[c].combine_chunks() for c in ("ids", "set")}
        ends = {c: np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for c, x in lists.items()}
        ids, tokens, begin, copies = lists["ids"].flatten(), lists["set"].flatten().to_numpy(), ends["ids"][:-1], np.diff(ends["ids"])

        def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.diff(ends["set"])[rows]
            at = np.concatenate([[0], np.cumsum(size)])
            return tokens[np.repeat(ends["set"][rows] - at[:-1], size) + np.arange(at[-1])], at

        def put(i: np.ndarray, j: np.ndarray, k: np.ndarray, u: np.ndarray) -> Iterator[pa.RecordBatch]:
            upto = np.concatenate([[0], np.cumsum(copies[i] * copies[j])])
            lo = 0
            while lo < len(i):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
                of = np.repeat(np.arange(lo, hi), np.diff(upto[lo : hi + 1]))
                nth = np.arange(upto[lo], upto[hi]) - upto[of]
                a, b = begin[i[of]] + nth // copies[j[of]], begin[j[of]] + nth % copies[j[of]]
                yield rows(ids.take(pa.array(a)), ids.take(pa.array(b)), k[of], u[of])
                lo = hi

        xs, ys = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        for i, j, k in _matches(side(xs), side(ys)):
            i, j = xs[i], ys[j]
            u = n[i] + n[j] - k
            ok = (k * 100 >= u * p) & (~np.bool_(alone) | (i < j))
            yield from put(i[ok], j[ok], k[ok], u[ok])
        for size in np.unique(copies[xs]) if alone else ():
            x, (one, other) = xs[copies[xs] == size], np.triu_indices(size, 1)
            for part in np.array_split(x, -(-len(x) * size * size // PAIRS)) if size > 1 else ():
                a, b = (np.repeat(begin[part], len(one)) + np.tile(nth, len(part)) for nth in (one, other))
                yield rows(ids.take(pa.array(a)), ids.take(pa.array(b)), np.repeat(n[part], len(one)), np.repeat(n[part], len(one)))

    return sent.groupBy("pair").applyInArrow(compare, f"a {key}, b {key}, k long, u long").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "k", "u")


def _classes(docs: DataFrame, id_col: str, max_df: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of equal sets: members (id, node), classes (node, rep, copies), and the tokens of each class by its rep (id, token, df)."""
    given = document_tokens(docs).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct("tokens")).alias("set")).where(F.size("set") > 0)
    members = materialize(given.select("id", F.sha2(F.array_join("set", " "), 256).alias("node")).distinct(), "members")
    first = members.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    toks = given.join(first.select("rep", "copies"), F.col("id") == F.col("rep")).select("id", "copies", F.explode("set").alias("token")).distinct()
    df = toks.groupBy("token").agg(F.sum("copies").alias("df"))
    return members, first, materialize(toks.join(df if max_df is None else df.where(F.col("df") <= max_df), "token").drop("copies"), "tokens")


def document_similarity(docs: DataFrame, id_col: str = "doc_id", min_percent: int = 0, max_df: int | None = None) -> DataFrame:
    """Jaccard similarity of token sets for all pairs that share a token: a, b, percent.

    ``min_percent`` leaves out pairs below it, before they meet. ``max_df``
    leaves out tokens of more documents than that and makes the result
    approximate. Documents without tokens are in no pair.
    """
    members, first, toks = _classes(docs, id_col, max_df)
    found = _pairs_by_counts(members, first, toks, min_percent) if min_percent < COUNT_PERCENT else _pairs_of_classes(members, first, toks, min_percent)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.round(100.0 * F.col("k") / F.col("u")).cast("long").alias("percent"))


def _pairs_of_classes(members: DataFrame, first: DataFrame, toks: DataFrame, p: int) -> DataFrame:
    """(id_a, id_b, k, u) of pairs of documents as similar: documents with equal sets are compared as one, their pairs come back at the end."""
    pairs = _similar_nodes(toks, p)
    placed = materialize(members.join(first, "node").select("id", "rep"), "placed")
    side = lambda k: placed.select(F.col("id").alias(f"id_{k}"), F.col("rep").alias(f"_{k}"))
    apart = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("id_a", "id_b", "k", "u")
    copies = side("a").join(side("b"), (F.col("_a") == F.col("_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b", F.lit(1).alias("k"), F.lit(1).alias("u"))
    return apart.unionByName(copies)


def most_similar(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("percent"), "a", "b").limit(1)


#: From which percent the most similar pair is looked for, until one is found.
STEPS = (99, 90, 70)


def most_similar_documents(docs: DataFrame, id_col: str = "doc_id", min_percent: int = 1) -> DataFrame:
    """``most_similar`` of all pairs of ``document_similarity``, which are made only down to the percent that decides.

    Of a pair of classes the smallest identifiers are the first pair, and of a
    class its two smallest. A pair left out at a step is rounded to that step's
    percent at most, so a better one that is found there is final.
    """
    members, first, toks = _classes(docs, id_col)
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where("k <= 2")
    copies = materialize(ranked.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b", F.lit(100).cast("long").alias("percent")), "copies")
    for least in [*(p for p in STEPS if p > min_percent), min_percent]:
        apart = _similar_nodes(toks, least).select("a", "b", F.round(100.0 * F.col("k") / F.col("u")).cast("long").alias("percent"))
        best = materialize(most_similar(apart.unionByName(copies)), "most-similar")
        if best.where(F.col("percent") > least).count():
            break
    return best


def documents_to_events(docs: DataFrame, name_col: str = "source", dataset: str = "documents", base: str = "2024-01-01 00:00:00", least: int = 20) -> DataFrame:
    """Paragraphs as events: trimmed, longer than ``least``; a document without any gives its first 1000 characters.

    An event's time is the first date in it that can be read, else ten minutes
    after the paragraph before, one day a document from ``base``.
    """
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > least)
    some = docs.where("text is not null").withColumn("_p", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(F.nullif(F.substring("text", 1, 1000), F.lit("")), F.lit("Empty document section")))))
    rows = some.select("doc_id", F.col(name_col).alias("actor"), F.posexplode("_p").alias("pos", "content"))
    when = F.to_timestamp(F.lit(base)) + F.make_dt_interval(F.col("doc_id").cast("int"), F.lit(0), F.col("pos") * 10)
    date = parse_ts(F.nullif(F.get(date_matches(F.col("content")), F.lit(0)), F.lit("")))
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(dataset), "doc_id", "pos"), 256).alias("id"), F.lit(dataset).alias("dataset_id"), "actor", F.coalesce(date, when).alias("ts"), F.lit("message").alias("event_type"), "content"
    )


# ---------------------------------------------------------------- tables


def profile_columns(df: DataFrame, sample: int | None = 50) -> DataFrame:
    """Each column's kind: date if a value with - or / reads as one, number if all values that aren't blank do, else text.

    The kind of a column is a guess from its first ``sample`` rows; None reads all.
    """
    rows = df if sample is None else df.limit(sample)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in df.columns])).alias("x")).select("x.column", "x.v")
    date = F.when(F.col("v").rlike("[-/]"), parse_ts(F.col("v")))
    stats = cells.groupBy("column").agg(F.count("v").alias("filled"), F.count(F.expr("try_cast(v as double)")).alias("numbers"), F.count(date).alias("dates"))
    number = (F.col("filled") > 0) & (F.col("numbers") == F.col("filled"))
    return stats.withColumn("kind", F.when(F.col("dates") > 0, F.lit("date")).when(number, F.lit("number")).otherwise(F.lit("text")))


def column_stats(df: DataFrame, columns: list[str], mode: str = "all_rows") -> DataFrame:
    """Mean (over all rows, or over those with a number), least and greatest value of each column."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.expr(f"try_cast(`{c}` as double)").alias("v")) for c in columns])).alias("x")).select("x.column", "x.v")
    n = F.count(F.lit(1)) if mode == "all_rows" else F.count("v")
    return cells.groupBy("column").agg(F.round(F.try_divide(F.coalesce(F.sum("v"), F.lit(0.0)), n), 2).alias("average"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


# Parts of column names that tell a gradebook.
SUBJECT = re.compile("math|science|english|physics|chem|grade|score|gpa|mark|exam", re.I)


def is_gradebook(profile: DataFrame) -> bool:
    """Two number columns and more, and a column named as a subject."""
    kinds = {r["column"]: r["kind"] for r in profile.select("column", "kind").collect()}
    return list(kinds.values()).count("number") >= 2 and any(SUBJECT.search(c) for c in kinds)


def gradebook_report(df: DataFrame, actor: str, subjects: list[str], weak: float = 70, limit: int = 50) -> dict[str, DataFrame]:
    """Means by actor and subject, grade points of 4 from the means of subjects, and the weakest results."""
    cells = df.select(F.col(actor).alias("actor"), F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.expr(f"try_cast(`{s}` as double)").alias("v")) for s in subjects])).alias("x")).select("actor", "x.subject", "x.v")
    means = cells.where("v is not null").groupBy("actor", "subject").agg(F.avg("v").alias("mean"))
    gpa = means.groupBy("actor").agg(F.round(F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.avg("mean") / 20 - 1)), 2).alias("gpa"))
    return {"means": means.withColumn("mean", F.round("mean", 2)), "gpa": gpa, "weak": means.where(F.col("mean") < weak).orderBy("mean", "actor", "subject").limit(limit)}
