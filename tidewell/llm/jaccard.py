"""A Jaccard self-join of shingle sets by PartEnum signatures.

Sizes are cut into bands whose ends differ by the threshold twice over, so linked
sets lie in one band or in two that follow each other. Within a band, linked sets
differ by k elements at most. The domain is cut into more than k parts, so two
linked sets are equal over some part, and a signature stands for one part of the
band and the set's elements there. Of a set's parts only the first k + 1 that have
elements sign, with the k of its own size: the first part over which two linked
sets are equal comes after k others at most, in both. A band has so many parts that
linked sets can't be equal over empty parts alone; the few sets of which that
isn't sure sign for empty parts as well. Parts with none but common elements, as a
passage of very many sets leaves them, come last: any order that depends on a part and its
content alone will do, so which elements are called common changes no result. A set signs
for its own band, and for the next if that can hold a larger partner.

Equal sets are one node from the start. A node carries a sketch, the parity of its
elements in about as many bits as it has elements: two sketches never differ in more
bits than their sets do in elements, so pairs that are too far apart go by their
sketches, and only the others are compared by sets. A signature's nodes are first
compared with one of them, its hub. Links merge nodes, and only nodes
that are still apart are compared further: in a small signature all pairs; in a large
one (beyond SMALL nodes) first with other hubs, and what then is apart in blocks of
nodes. There sketches join nodes of different components that may be linked to groups
over all signatures, and a group's blocks are compared by sets, in a task that returns
links alone. Both ways are exact, and the size of a signature alone chooses between them. So a group of
copies costs a few comparisons for each node, and no link between two components is
lost.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOOM_KEYS, bloom_bits, bloom_of, discard, in_arrow, in_bloom, materialize, mix, shingles, word_hashes
from .components import components

WIDTH, PERCENT = 3, 90
#: Rows and signatures that a task holds before it puts them out.
SIGNED_ROWS, SIGNED_SIGS = 10_000, 1 << 20
SIGNED = "doc_id long, text_key long, n long, node long, checked long, sketch binary, sigs array<long>, heads array<long>, again array<long>, again_head array<long>"


@lru_cache(maxsize=64)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band, up to 2**31 elements."""
    first, last, at = [], [], 1
    while at < 1 << 31:
        first.append(at)
        last.append(at * 10_000 // percent**2)
        at = last[-1] + 1
    return np.array(first), np.array(last)


def differences(n: int, m: int, percent: int) -> int:
    """How many elements linked sets of n and m elements may differ in."""
    return (n + m) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def parts(last: int, percent: int) -> np.ndarray:
    """The first hash of each part of the domain but the first, for a band that ends at ``last``.

    There are more parts than differences, by about as many as a set has empty parts.
    """
    k = differences(last, last, percent)
    count = k + 1
    for spare in range(1, k // 2 + 3):
        count = k + 1 + spare
        empty = count * np.exp(-last / count)
        if spare >= empty + 3 * empty**0.5:
            break
    return np.array([-((-i << 64) // count) for i in range(1, count)], np.uint64)


def distinct_shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words are one, none give none."""
    s = np.sort(shingles(word_hashes()(text), width))
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def signatures(s: np.ndarray, percent: int = PERCENT, mixed: np.ndarray | None = None, common: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a sorted set of hashes, for its own band and, if a larger set of it can be linked, the next.

    ``mixed`` is the set's mix(s, 7), if that is known. Parts that hold none but
    ``common`` hashes (sorted) sign only where others don't suffice.
    """
    first, last = bands(percent)
    n = len(s)
    own = int(np.searchsorted(last, n))
    sums = rare = None
    if common is not None and len(common):
        rare = np.concatenate([[0], np.cumsum(common[np.searchsorted(common[:-1], s)] != s)])
    out = [np.zeros(0, np.uint64)]
    for band in (own, own + 1) if 100 * n >= percent * first[own + 1] else (own,):
        k = differences(n, min(100 * n // percent, int(last[band])), percent)
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(s, 7) if mixed is None else mixed, out=sums[1:])
        if k == 0:  # linked sets are equal
            out.append(mix(sums[-1:], 1000 + band))
            continue
        starts = parts(int(last[band]), percent)
        ends = np.concatenate([[0], np.searchsorted(s, starts), [n]])
        full = np.flatnonzero(ends[1:] > ends[:-1])
        count = len(ends) - 1
        if rare is not None:
            weak = rare[ends[full + 1]] == rare[ends[full]]
            full = np.concatenate([full[~weak], full[weak]])
        at = full[: k + 1]
        if count - len(full) > count - k - 1:
            at = np.union1d(at, np.arange(k + 1))
        out.append(mix((sums[ends[at + 1]] - sums[ends[at]]) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1000 + band))
    return np.concatenate(out)


def sketch_of(s: np.ndarray) -> bytes:
    """The parity of a set's elements in as many bits as the next power of two has, 64 at least."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes: its halves are laid on each other until it fits."""
    out = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(out.reshape(-1, size)) if len(out) > size else out


#: About so many distinct texts are looked through for common shingles; those in this share of them and in MET texts count, and are kept up to a number.
SAMPLED, SHARE, MET, COMMON = 4096, 1 / 512, 8, 1 << 15


def common_shingles(docs: DataFrame, width: int = WIDTH, text_col: str = "text") -> np.ndarray:
    """The sorted hashes of shingles that many distinct texts of a sample, picked by hash, have; COMMON at most reach the driver."""
    text = F.col(f"`{text_col}`").cast("string")
    every = max(1, docs.count() // SAMPLED)
    texts = docs.select(F.xxhash64(text, F.lit(9)).alias("k"), text.alias("text")).where(F.pmod("k", F.lit(every)) == 0).groupBy("k").agg(F.first("text").alias("text")).select("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([distinct_shingles(x.as_py(), width).view(np.int64) for x in batch.column(0)], pa.list_(pa.int64()))], names=["set"])

    sets = materialize(in_arrow(texts, run, "set array<long>"), "sampled")
    least = max(MET, int(sets.count() * SHARE))
    found = sets.select(F.explode("set").alias("h")).groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    discard(sets)
    return np.sort(found["h"].to_numpy().view(np.uint64))


def sign(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", common: np.ndarray | None = None) -> DataFrame:
    """Each row's set size, node (a hash of its set; null if empty), second hash, and, once a task, its sketch and signatures.

    Rows are put out by stretches of SIGNED_ROWS rows or SIGNED_SIGS signatures.
    Of the nodes of a stretch that share a signature the first has it in
    ``heads``; the others have it in ``again``, with that first node in
    ``again_head``. So a signature of very many nodes is dealt out once a stretch.
    """

    def put_out(ids, keys, n, nodes, checks, sketches, signers, found):
        flat, owner = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), np.repeat(np.arange(len(n)), signers)
        _, at, inverse, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        is_first = np.zeros(len(flat), bool)
        is_first[at] = True
        many = times[inverse] > 1
        key = np.array([x or 0 for x in nodes], np.int64)

        def lists(mask, values):
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[mask], minlength=len(n)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[mask]))

        cols = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary())]
        cols += [lists(is_first & ~many, flat), lists(is_first & many, flat), lists(~is_first, flat), lists(~is_first, key[owner[at]][inverse] if len(flat) else flat)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SIGNED.split(", ")])

    def run(batches):
        seen: set[int] = set()
        held, sigs = tuple([] for _ in range(8)), 0
        ids, keys, n, nodes, checks, sketches, signers, found = held
        for batch in batches:
            # No slice of a batch is kept, as it would hold the batch's texts.
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = distinct_shingles(text, width)
                node = check = sketch = None
                signers.append(0)
                if len(s):
                    mixed = mix(s, 7)
                    node, check = mix(np.array([mixed.sum(), (mixed * mixed).sum()], np.uint64) + np.uint64(len(s)), 3).view(np.int64).tolist()
                    if node not in seen:
                        seen.add(node)
                        sketch = sketch_of(s)
                        found.append(signatures(s, percent, mixed, common))
                        signers[-1] = len(found[-1])
                        sigs += signers[-1]
                for column, value in zip(held, (doc_id, key, len(s), node, check, sketch)):
                    column.append(value)
                if len(n) >= SIGNED_ROWS or sigs >= SIGNED_SIGS:
                    yield put_out(*held)
                    sigs = 0
                    for column in held:
                        column.clear()
        if n:
            yield put_out(*held)

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return in_arrow(rows, run, SIGNED)


def shared(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of two nodes or more: (sig, node) of all their nodes, the pairs (a, b) of nodes with their hubs, and the written table behind both.

    Signatures are dealt out once, one row for each batch that has it; a
    signature's hub is the smallest of these nodes, and a batch's other nodes
    are paired with the batch's first.
    """
    once = signed.where("size(sigs) > 0").select("node", F.explode("sigs").alias("sig"), F.lit(False).alias("more"))
    heads = signed.where("size(heads) > 0").select("node", F.explode("heads").alias("sig"), F.lit(True).alias("more"))
    of = Window.partitionBy("sig")
    counted = once.unionByName(heads).select("sig", "node", "more", F.min("node").over(of).alias("hub"), F.max("node").over(of).alias("top"))
    first = materialize(counted.where("more or hub < top").select("sig", "node", "hub"), "heads")
    again = signed.where("size(again) > 0").select("node", F.explode(F.arrays_zip("again", "again_head")).alias("x")).select(F.col("x.again").alias("sig"), "node", F.col("x.again_head").alias("hub"))
    both = first.unionByName(again)
    pairs = both.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    return both.select("sig", "node"), pairs, first


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that their sketches and sizes don't rule out."""
    x, y = (sketches.select(F.col("node").alias(f"_{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    met = pairs.select("a", "b").join(x, F.col("a") == F.col("_a")).select("a", "b", "na", "sa").join(y, F.col("b") == F.col("_b"))
    near = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            allowed = batch.column(2).to_numpy() * (100 - percent)
            for i, (one, other) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                size = min(len(one), len(other))
                apart = int(np.bitwise_count(folded(one, size) ^ folded(other, size)).sum())
                ok[i] = apart * (100 + percent) <= allowed[i]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return in_arrow(near, run, "a long, b long")


def sets_of(docs: DataFrame, signed: DataFrame, pairs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The sets of the nodes in ``pairs``: node, set. Texts that no pair needs are passed over by a Bloom filter of the needed ones.

    More keys than a filter holds are looked for in several passes over the texts.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    chosen = materialize(signed.join(needed, F.col("node") == F.col("_n"), "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")), "needed")
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.xxhash64(text).alias("k"), text.alias("text"))
    n = chosen.count()
    passes = max(1, -(-n // BLOOM_KEYS))
    made = reduce(DataFrame.unionByName, [_sets_in(texts, bloom_of(chosen.where(F.pmod("text_key", F.lit(passes)) == p), "text_key", bloom_bits(-(-n // passes))), width, passes, p) for p in range(passes)])
    met = made.withColumnRenamed("text_key", "_k").join(chosen, F.col("_k") == F.col("text_key")).select("node", "set")
    sets = materialize(met.groupBy("node").agg(F.min("set").alias("set")), "sets")
    discard(chosen)
    return sets


def _sets_in(texts: DataFrame, bitmap: bytes, width: int, passes: int, turn: int) -> DataFrame:
    """(text_key, set) of the texts whose keys may be in the filter, of every ``passes``-th key; once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = np.flatnonzero(in_bloom(bitmap, keys.view(np.uint64)) & (keys % passes == turn))
            got, sets, texts = [], [], batch.column(1)
            for i in at.tolist():
                key = int(keys[i])
                if key not in seen:
                    seen.add(key)
                    got.append(key)
                    sets.append(distinct_shingles(texts[i].as_py(), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "set"])

    return in_arrow(texts, run, "text_key long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity reaches the threshold, exactly."""
    a, b = sets.select(F.col("node").alias("_a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("_b"), F.col("set").alias("sb"))
    met = pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    near = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(near).where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


#: More hubs of large signatures; nodes of a signature beyond which blocks are compared; nodes of a block.
HUBS, SMALL, BLOCK = 2, 32, 512


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Adds comp, a node's label, or itself."""
    met = rows.join(label.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left")
    return met.select(*rows.columns, F.coalesce("label", "node").alias("comp"))


def _first_labels(links: DataFrame) -> DataFrame:
    """(node, label) of linked nodes: where a node's least neighbour, that one's, and so on for four steps lead.

    A label is in its node's component, so nodes of a label need no further
    comparison; nodes of one component may still have several labels.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for step in ("least", "least-of-least"):
        label = materialize(label, step)
        label = label.join(label.select(F.col("node").alias("_n"), F.col("label").alias("up")), F.col("label") == F.col("_n")).select("node", F.col("up").alias("label"))
    return label


def _open(members: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """Members (sig, node, m, comp) of signatures with more than ``least`` nodes, of several labels; one signature of those with equal nodes."""
    at = materialize(_labelled(members, label), "labelled")  # read twice
    facts = at.groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    left = facts.where((F.col("c1") < F.col("c2")) & (F.col("m") > least)).groupBy("m", "h").agg(F.min("sig").alias("_s")).select("_s", F.col("m"))
    # Written first, so that a signature of very many nodes isn't shuffled where few signatures are left.
    sigs = materialize(left, "open-sigs")
    found = materialize(at.join(sigs, F.col("sig") == F.col("_s")).select("sig", "node", "m", "comp"), "open")
    discard(at, sigs)
    return found


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each open signature's nodes with HUBS of them, picked by hash, where their labels differ."""
    pick = lambda turn: F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), "node", "comp"))
    hubs = materialize(rows.groupBy(F.col("sig").alias("_s")).agg(F.array(*[pick(turn) for turn in range(HUBS)]).alias("hubs")), "hubs")
    # Hubs of a node's own component make no row.
    met = rows.join(hubs, F.col("sig") == F.col("_s")).select("node", F.explode(F.filter("hubs", lambda h: h["comp"] != F.col("comp"))).alias("hub"))
    return met.select(F.greatest("node", F.col("hub.node")).alias("a"), F.least("node", F.col("hub.node")).alias("b")).distinct()


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components in a small signature."""
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.sig = y.sig and x.comp < y.comp"))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """The nodes (pair, node, comp) of each pair of blocks of a large signature.

    Nodes of one large component fill blocks of their own; a block of it isn't
    compared with others of it.
    """
    sizes = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("k"))
    bulk = F.col("k") >= BLOCK // 2
    total = sizes.groupBy("sig").agg(F.sum(F.when(~bulk, F.col("k"))).alias("loose"))
    dealt = sizes.join(total, "sig").select(F.col("sig").alias("_s"), F.col("comp").alias("_c"), F.when(bulk, F.col("comp")).alias("own"), F.ceil(F.when(bulk, F.col("k")).otherwise(F.col("loose")) / BLOCK).alias("blocks"))
    dealt = materialize(dealt, "blocks")
    placed = rows.join(dealt, (F.col("sig") == F.col("_s")) & (F.col("comp") == F.col("_c"))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    placed = materialize(placed.select("sig", "node", "comp", "own", "block"), "placed-blocks")
    blocks = placed.select("sig", "own", "block").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    key = lambda t: f"struct({t}.own, {t}.block)"
    pairs = x.join(y, F.expr(f"x.sig = y.sig and {key('x')} <= {key('y')} and not coalesce(x.own = y.own, false)"))
    pairs = pairs.selectExpr("x.sig as _s", "x.own as own1", "x.block as block1", "y.own as own2", "y.block as block2").withColumn("pair", F.xxhash64("_s", "own1", "block1", "own2", "block2"))
    sides = pairs.selectExpr("pair", "_s", "explode(array_distinct(array(struct(own1 as own, block1 as block), struct(own2 as own, block2 as block)))) as s")
    sides = materialize(sides.select("pair", "_s", F.col("s.own").alias("_o"), F.col("s.block").alias("_b")), "sides")
    return placed.join(sides, (F.col("sig") == F.col("_s")) & F.col("own").eqNullSafe(F.col("_o")) & (F.col("block") == F.col("_b"))).select("pair", "node", "comp")


def _near(table: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of a task's nodes, of different components, sketches and sizes don't rule out."""
    comp, n = table.column("comp").to_numpy(), table.column("n").to_numpy()
    sketches = table.column("sketch").to_pylist()
    size = min(map(len, sketches))
    # Equal bits less unequal ones, for all pairs at once: a product of signs, of some thousand bits at a time.
    bits, same = np.array([folded(x, size) for x in sketches]), np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, size, 512):
        signs = np.unpackbits(bits[:, lo : lo + 512], axis=1).astype(np.float32) * 2 - 1
        same += signs @ signs.T
    apart = (8 * size - same) / 2
    return (apart * (100 + percent) <= (n[:, None] + n[None, :]) * (100 - percent)) & (comp[:, None] != comp[None, :])


def _with_sketches(sent: DataFrame, sketches: DataFrame) -> DataFrame:
    return sent.join(sketches.select(F.col("node").alias("_n"), "n", "sketch"), F.col("node") == F.col("_n")).select("pair", "node", "comp", "n", "sketch")


def _maybe_linked(sent: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The nodes (pair, node, comp) of block pairs that have a partner of another component there, by sketches."""

    def screen(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.select(["pair", "node", "comp"]).filter(pa.array(_near(table, percent).any(axis=1)))

    return _with_sketches(sent, sketches).groupBy("pair").applyInArrow(screen, "pair long, node long, comp long")


def _near_groups(sent: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join what sketches don't rule out in block pairs: fewer rows than a task has nodes.

    Two nodes of a pair here need not be near themselves; a chain of near ones leads from one to the other.
    """

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, near = table.column("node").to_numpy(), _near(table, percent)
        least = np.arange(len(node))
        while True:
            new = np.minimum(least, np.where(near, least[None, :], len(node)).min(axis=1))
            new = new[new]
            if (new == least).all():
                break
            least = new
        more = np.flatnonzero(least < np.arange(len(node)))
        return pa.table({"a": pa.array(node[more], pa.int64()), "b": pa.array(node[least[more]], pa.int64())})

    return _with_sketches(sent, sketches).groupBy("pair").applyInArrow(join, "a long, b long")


def _block_links(sent: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in pairs of blocks, by a matrix product; no more than join a task's components."""
    full = sent.join(sets.select(F.col("node").alias("_n"), "set"), F.col("node") == F.col("_n")).select("pair", "node", "comp", "set")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        lists = table.column("set").combine_chunks()
        flat, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        values, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1
        col = (np.cumsum(shared) - 1)[where]
        ok = shared[where]
        common = np.zeros((len(n), len(n)), np.float32)
        for lo in range(0, int(shared.sum()), 4096):  # a few thousand elements at a time
            m = np.zeros((len(n), 4096), np.float32)
            now = ok & (col >= lo) & (col < lo + 4096)
            m[row[now], col[now] - lo] = 1
            common += m @ m.T
        common = common.astype(np.int64)
        link = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comp[:, None] < comp[None, :])
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(link)):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[a] = b
                out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return full.groupBy("pair").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_shingles, node, component (a node) and component_id.

    Rows link when their sets' similarity is ``percent`` hundredths or more;
    component_id is the smallest doc_id that links lead to, the row's own
    included. Rows with equal sets are one node; nodes are 64-bit hashes, and a
    second hash stops the query should two sets meet in one.

    A text that is null or has no word is linked with nothing: node and
    component are null and component_id is its doc_id. A null doc_id takes part
    in links, but isn't the smallest unless a component has no other.
    """
    signed = materialize(sign(docs, width, percent, id_col, text_col, common_shingles(docs, width, text_col)), "signed")
    sketches = materialize(signed.where("sketch is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sketches")
    members, stars, heads = shared(signed)
    rows = signed.select("doc_id", "text_key", "n", "node", "checked")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        """The linked ones of pairs that may be; what it takes to tell them is deleted at once."""
        sets = sets_of(docs, rows, pairs, width, id_col, text_col)
        found = materialize(verified(pairs, sets, percent), label)
        discard(pairs, sets)
        return found

    links = [linked(materialize(may_link(stars, sketches, percent), "star-near"), "star-links")]
    open_ = _open(members, _first_labels(links[0]), 2)
    large = open_.where(F.col("m") > SMALL)
    rows = materialize(rows, "rows")
    discard(signed, heads)  # no signature is read any more
    near = materialize(may_link(_small_pairs(open_.where(F.col("m") <= SMALL)).unionByName(_hub_pairs(large)).distinct(), sketches, percent), "open-near")
    links.append(linked(near, "open-links"))
    label = components(reduce(DataFrame.unionByName, links))
    if not large.isEmpty():
        # Of what exact components leave apart, sketches first tell groups that hold all links left: a node has one
        # group, whatever number of signatures it has, so its set is sent once for each block of that group.
        near = materialize(_near_groups(_block_pairs(_open(large.select("sig", "node"), label, SMALL)), sketches, percent), "near-groups")
        groups = _labelled(components(near).select(F.col("label").alias("sig"), "node"), label)
        sent = materialize(_maybe_linked(_block_pairs(groups), sketches, percent), "screened")
        discard(near)
        sets = sets_of(docs, rows, sent.selectExpr("node as a", "node as b"), width, id_col, text_col)
        links.append(materialize(_block_links(sent, sets, percent), "block-links"))
        discard(sent, sets)
        if not links[-1].isEmpty():
            label = components(reduce(DataFrame.unionByName, links))
    discard(open_, sketches)
    return _result(rows, label)


def _result(signed: DataFrame, label: DataFrame) -> DataFrame:
    one = F.when(F.min("checked") == F.max("checked"), F.min("doc_id")).otherwise(F.raise_error(F.lit("two sets share a 64-bit hash")).cast("long"))
    nodes = signed.where("node is not null").groupBy("node").agg(one.alias("least"))
    comp = nodes.join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("label", "node").alias("component"))
    comp = materialize(comp, "nodes")
    ids = comp.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("component_id"))
    placed = materialize(comp.join(ids, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "component", "component_id"), "placed")
    # A row without words meets no node; its key only spreads such rows.
    rows = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node", F.coalesce("node", F.xxhash64("doc_id", F.lit("none"))).alias("_k"))
    met = rows.join(placed, F.col("_k") == F.col("_n"), "left")
    linked = F.col("node").isNotNull()
    return met.select(
        "doc_id", "text_key", "n_shingles", "node", F.when(linked, F.col("component")).alias("component"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's, and of its rows the one of the smallest text key.

    Rows without words stay. Rows that are equal in identifier and text are one.
    """
    found = materialize(near_duplicates(docs, width, percent, id_col, text_col), "found")
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")).select(F.col("component").alias("_c"), "k")
    kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("text_key").eqNullSafe(F.col("k.text_key"))
    row = ["doc_id", "text_key"]
    dropped = found.where("component is not null").join(best, F.col("component") == F.col("_c")).where(~kept).select(*row).distinct()
    # Copies and repeated rows are few beside all rows, and their sizes are known before texts are joined.
    dropped = materialize(dropped, "dropped")
    many = materialize(found.groupBy(*row).count().where("count > 1").select(*row), "repeated")
    same = lambda k: docs[f"`{id_col}`"].cast("long").eqNullSafe(k["doc_id"]) & F.xxhash64(docs[f"`{text_col}`"].cast("string")).eqNullSafe(k["text_key"])
    left = docs.join(dropped, same(dropped), "left_anti")
    return left.join(many, same(many), "left_anti").unionByName(left.join(many, same(many), "left_semi").dropDuplicates([id_col, text_col]))
