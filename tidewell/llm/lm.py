"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of the bigram, the
unigram and a uniform model. The weights depend on how often the context was
seen; expectation-maximisation learns them on held-out counts, that is on a
fifth of the documents, from counts of the other training documents.

Counts are gathered without a table of the vocabulary in any one place. Tasks
cut the corpus into blocks of about a million tokens. A block asks for each of
its distinct words and bigrams once, sorted and cut by ranges of their hashes;
a range's task adds up what all blocks counted and answers each block in its
own order. So a frequent word is one number a block, no range is hot, and
memory is that of a block or a range. Blocks are written once in buckets and
meet their answers where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize, mix, word_hashes

BLOCK_TOKENS = 1 << 20
#: Bits of a bigram's hash: fewer make the questions shorter. Of n bigrams, each meets another with a chance of n / 2**56.
BIGRAM_BITS = 56
FOLDS, EVAL_FOLD, WEIGHT_FOLD = 5, 1, 2
#: Contexts seen 2**(b-1) to 2**b - 1 times share bucket b; bucket 0 is for unseen ones.
BUCKETS = 48
#: Bins of held-out probabilities: half powers of two; the last stands for zero.
BINS = 128
EM_ROUNDS = 60
#: Hashes of the marks before and after a text. Words are hashed otherwise, and can't be empty.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)

_BLOCK = "block long, doc_ids array<long>, folds binary, lens binary, spots binary, vocab binary"
_ASK = "part int, block long, keys1 binary, fit1 binary, held1 binary, keys2 binary, fit2 binary, held2 binary"
_ANSWER = "part int, block long, fit1 binary, held1 binary, fit2 binary, held2 binary, types_fit long, types long, tokens_fit long, tokens long"


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, all first ones first: high zero bytes then compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block: its documents' identifiers, folds and lengths, and its tokens as places in its vocabulary."""
    fold = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fold.cast("int").alias("fold"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches):
        part, seq, hashes = TaskContext.get().partitionId(), 0, word_hashes()
        ids, folds, held, n = [], [], [], 0

        def block():
            lens = np.array([len(h) for h in held], np.uint32)
            vocab, spots, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            cells = [(part << 33) + seq, ids, np.array(folds, np.uint8).tobytes(), lens.tobytes(), _planes(rank[spots]), vocab[order].tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for doc_id, f, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = hashes(text)
                ids.append(doc_id)
                folds.append(f)
                held.append(np.concatenate([[BEGIN], h, [END]]).astype(np.uint64))
                n += len(h) + 2
                if n >= BLOCK_TOKENS:
                    yield block()
                    ids, folds, held, n, seq = [], [], [], 0, seq + 1
        if ids:
            yield block()

    return rows.mapInArrow(cut, _BLOCK)


class Grams:
    """A block's tokens, and its distinct words and bigrams in the order of their hashes."""

    def __init__(self, folds: bytes, lens: bytes, spots: bytes, vocab: bytes):
        self.folds, self.lens = np.frombuffer(folds, np.uint8), np.frombuffer(lens, np.uint32).astype(np.int64)
        vocab, spots = np.frombuffer(vocab, np.uint64), _unplanes(spots, np.uint32)
        order = np.argsort(vocab)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys1, self.words = vocab[order], rank[spots]
        starts = np.cumsum(self.lens) - self.lens
        predicted = np.ones(len(spots), bool)
        predicted[starts] = False
        self.at = np.flatnonzero(predicted)  # all tokens but the marks before texts
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens - 1)
        codes, pairs = np.unique(self.words[self.at - 1] << 32 | self.words[self.at], return_inverse=True)
        keys2 = mix(self.keys1[codes >> 32] * np.uint64(0x100000001B3) + self.keys1[codes & 0xFFFFFFFF], 2) >> np.uint64(64 - BIGRAM_BITS)
        order = np.argsort(keys2)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys2, self.pairs = keys2[order], rank[pairs]

    def counts(self, fold_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and bigram occurs in the documents of some folds."""
        token_ok = np.repeat(fold_ok, self.lens)
        one = np.bincount(self.words[token_ok], minlength=len(self.keys1)).astype(np.uint32)
        two = np.bincount(self.pairs[token_ok[self.at]], minlength=len(self.keys2)).astype(np.uint32)
        return one, two


def _cuts(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    step = (1 << bits) // parts
    return np.concatenate([[0], np.searchsorted(keys, np.array([step * p for p in range(1, parts)], np.uint64)), [len(keys)]])


def questions(cut: DataFrame, parts: int) -> DataFrame:
    """What each block counted, by ranges of hashes."""

    def ask(batches):
        for batch in batches:
            for block, folds, lens, spots, vocab in zip(*(batch.column(i).to_pylist() for i in range(5))):
                g = Grams(folds, lens, spots, vocab)
                held = g.folds == WEIGHT_FOLD
                fit1, fit2 = g.counts((g.folds != EVAL_FOLD) & ~held)
                held1, held2 = g.counts(held)
                a, b = _cuts(g.keys1, parts, 64), _cuts(g.keys2, parts, BIGRAM_BITS)
                out = []
                for p in range(parts):
                    x, y = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                    if a[p] < a[p + 1] or b[p] < b[p + 1]:
                        out.append((p, block, pack_sorted(g.keys1[x]), _planes(fit1[x]), _planes(held1[x]), pack_sorted(g.keys2[y]), _planes(fit2[y]), _planes(held2[y])))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _ASK.split(", ")])

    return cut.select("block", "folds", "lens", "spots", "vocab").mapInArrow(ask, _ASK)


def answers(asked: DataFrame) -> DataFrame:
    """For each block and range the counts of all blocks, in the block's order; and each range's totals (block null)."""

    def add(table: pa.Table) -> pa.Table:
        part, block_ids = table.column("part")[0].as_py(), table.column("block").to_pylist()
        out = {c.split()[0]: [] for c in _ANSWER.split(", ")}
        cells: dict[str, list[bytes]] = {}
        totals = {}
        for n in "12":
            keys = [unpack_sorted(x) for x in table.column(f"keys{n}").to_pylist()]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            for what in ("fit", "held"):
                own = np.concatenate([_unplanes(x, np.uint32) for x in table.column(what + n).to_pylist()])
                total = np.bincount(where, weights=own, minlength=len(found)).astype(np.int64)
                cells[what + n] = [x.tobytes() for x in np.split(total[where], ends)]
                totals[what + n] = total
            if n == "1":
                real = found != BEGIN
        for i, block in enumerate(block_ids):
            for k, v in zip(out, (part, block, *(cells[c][i] for c in ("fit1", "held1", "fit2", "held2")), None, None, None, None)):
                out[k].append(v)
        fit, both = totals["fit1"][real], (totals["fit1"] + totals["held1"])[real]
        for k, v in zip(out, (part, None, None, None, None, None, int((fit > 0).sum()), int((both > 0).sum()), int(fit.sum()), int(both.sum()))):
            out[k].append(v)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 4]
        return pa.table([pa.array(out[k], t) for k, t in zip(out, kinds)], names=list(out))

    return asked.groupBy("part").applyInArrow(add, _ANSWER)


def _counts(table: pa.Table, g: Grams, held: bool) -> tuple[np.ndarray, ...]:
    """A block's counts of bigram, context and word at each predicted token."""
    table = table.sort_by("part")
    read = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64)
    one, two = read("fit1"), read("fit2")
    if held:
        one, two = one + read("held1"), two + read("held2")
    return two[g.pairs], one[g.words[g.at - 1]], one[g.words[g.at]]


def context_bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(np.float64))[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-2 * np.log2(p)), BINS - 2), BINS - 1).astype(np.int64)


def _grams(table: pa.Table) -> Grams:
    return Grams(*(table.column(c)[0].as_py() for c in ("folds", "lens", "spots", "vocab")))


def held_out_bins(cut: DataFrame, answered: DataFrame, n_fit: int) -> DataFrame:
    """Held-out tokens by context bucket and by bins of their bigram and unigram estimates: bin, k."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        g = _grams(left)
        own = (g.folds == WEIGHT_FOLD)[g.doc]
        two, ctx, one = (x[own] for x in _counts(right, g, held=False))
        p2, p1 = two / np.maximum(ctx, 1), one / max(n_fit, 1)
        cell, k = np.unique((context_bucket(ctx) * BINS + _bin(p2)) * BINS + _bin(p1), return_counts=True)
        return pa.table({"bin": pa.array(cell, pa.int64()), "k": pa.array(k, pa.int64())})

    made = cut.select("block", "folds", "lens", "spots", "vocab").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(count, "bin long, k long")
    return made.groupBy("bin").agg(F.sum("k").alias("k"))


def learn_weights(bins: np.ndarray, k: np.ndarray, types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and uniform model for each bucket, by expectation-maximisation.

    The weights of all buckets together come first; each bucket's are then
    learned from its own counts and one token's worth of the common ones, so a
    bucket without counts has the common weights. Without any held-out token
    these are 0.4, 0.4 and 0.2.
    """
    value = np.append(2.0 ** (-np.arange(BINS - 1) / 2), 0.0)
    bucket, p = bins // BINS**2, np.stack([value[bins // BINS % BINS], value[bins % BINS], np.full(len(bins), 1 / (types + 1))])

    def em(start: np.ndarray, p: np.ndarray, k: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(rounds):
            part = w[:, None] * p
            w = (part / part.sum(0) * k).sum(1) + prior
            w = w / w.sum()
        return w

    common = np.array([0.4, 0.4, 0.2])
    if k.sum():
        common = em(common, p, k, common * 1e-3)
    out = np.tile(common, (BUCKETS, 1))
    for b in np.unique(bucket):
        own = bucket == b
        out[b] = em(common, p[:, own], k[own], common)
    return out


def interpolation_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(identifier as text) mod 5 is 1 are held out of
    training. Words lie between ASCII white space, A-Z lower-cased; each text
    has one end token more. ``base_score`` is the smoothed unigram's log10
    probability, ``score`` the interpolated model's. ``parts`` is the number of
    ranges of hashes, four for each shuffle partition by default.

    A null text is empty; a null identifier counts as empty text and so is in
    training; repeated rows count and are scored each. Without training tokens
    both scores are 0. No rows give none.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = bucketed(blocks(docs, id_col, text_col), "blocks", "block", max(1, parts // 4))
    answered = materialize(answers(questions(cut, parts)), "answers")
    stats = answered.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types_fit", "types", "tokens_fit", "tokens")]).first()
    answered = answered.where("block is not null").drop("types_fit", "types", "tokens_fit", "tokens")
    found = held_out_bins(cut, answered.select("part", "block", "fit1", "fit2"), stats.tokens_fit).toArrow()
    weights = learn_weights(found.column("bin").to_numpy(), found.column("k").to_numpy(), stats.types_fit)
    n, v = stats.tokens, stats.types
    # A context that was never seen has no bigram estimate; its weight goes to the others, so probabilities sum to 1.
    unseen = np.array([0.0, *weights[0, 1:] / weights[0, 1:].sum()])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        g = _grams(left)
        two, ctx, one = _counts(right, g, held=True)
        w = np.where((ctx > 0)[:, None], weights[context_bucket(ctx)], unseen)
        p = w[:, 0] * two / np.maximum(ctx, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
        if not n:
            p = np.ones(len(one))
        base = np.log10((one + 0.5) / (n + 0.5 * (v + 1)))
        total = lambda x: np.bincount(g.doc, weights=x, minlength=len(g.lens))
        cols = {
            "doc_id": left.column("doc_ids")[0].values,
            "held_out": pa.array(g.folds == EVAL_FOLD),
            "n_tokens": pa.array(g.lens - 1),
            "n_known": pa.array(total((one > 0).astype(np.float64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(g.lens), n, np.int64)),
            "base_score": pa.array(total(base)),
            "score": pa.array(total(np.log10(p))),
        }
        return pa.table(cols)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return cut.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)
