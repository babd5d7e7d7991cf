"""An inverted-file index of vectors: probed for a few cells, or searched exactly by the cells' reach."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialize

#: Vectors that the cells are fitted on at most, cells at most, and vectors of a cell that one task compares.
SAMPLE, CELLS, BLOCK = 10_000, 1024, 4096
#: Packs of cells that vectors are dealt to, and a pack's vectors at least and at most.
PACKS, PACK_ROWS = 24, (1024, 16_384)
#: Queries that one task compares with a pack, and that are looked for at once: what is written and shuffled for them is deleted before the next ones.
QUERIES, ROUND = 16_384, 16_384
#: Vectors by whose exact neighbours the number of probed cells is chosen.
SAMPLED_QUERIES = 200
#: What is added to a bound, so that rounding never leaves a vector out.
SLACK = 1e-6


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(cells) -> np.ndarray:
    return unit(np.stack([np.asarray(c, np.float64) for c in cells]))


def fit_cells(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` unit centroids of unit vectors by spherical k-means; each new seed is the vector farthest from those before."""
    seeds, near = [0], sample @ sample[0]
    while len(seeds) < min(k, len(sample)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[seeds[-1]])
    centroids = sample[seeds]
    for _ in range(rounds):
        cell = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), centroids)
    return centroids


def usable(vector: Column) -> Column:
    """Vectors with components, none null, NaN or infinite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


@dataclass
class VectorIndex:
    """Rows (cell, part, pack, id, v) of all vectors, the cells' centroids, how far in angle their vectors lie at most, their parts, and the pack of each part.

    Small parts of several cells are one pack, so a query is sent once for many cells.
    """

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    parts: np.ndarray
    packs: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
        """Indexes every usable vector; cells (the square root of the rows, CELLS at most) are fitted on ``sample`` rows picked by hash.

        All vectors have one length. A cell beyond ``block`` vectors is dealt to
        several parts. Vectors that are null, empty or hold a null, NaN or
        infinity are left out.
        """
        given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<float>").alias("v")).where(usable(F.col("v")))
        picked = given.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
        if not len(picked):
            return cls(given.selectExpr("0 as cell", "0 as part", "0 as pack", "id", "v"), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        centroids = fit_cells(_matrix(picked), cells or min(CELLS, max(1, round(given.count() ** 0.5))))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    s = _matrix(f["v"]) @ centroids.T
                    cell = s.argmax(axis=1)
                    zero = np.array([not np.any(v) for v in f["v"]])
                    angle = np.where(zero, np.pi, np.arccos(np.clip(s[np.arange(len(f)), cell], -1, 1)))
                    yield pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle, "id": f["id"], "v": f["v"]})

        placed = materialize(given.mapInPandas(place, "cell int, angle double, id long, v array<float>"), "vectors")
        reach, parts, counts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # CELLS rows at most
            reach[r["cell"]], parts[r["cell"]], counts[r["cell"]] = r["angle"], -(-r["n"] // block), r["n"]
        packs, share, filled = np.zeros(parts.sum(), np.int64), min(max(counts.sum() / PACKS, PACK_ROWS[0]), PACK_ROWS[1]), 0.0
        for i, rows in enumerate(np.repeat(counts / np.maximum(parts, 1), parts)):
            new = i > 0 and filled + rows > share
            filled = rows if new else filled + rows
            packs[i] = packs[max(i - 1, 0)] + new
        value = lambda a, at: F.get(F.array(*[F.lit(int(x)) for x in a]), at)
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), value(parts, F.col("cell"))).cast("int"))
        pack = value(packs, value(np.cumsum(parts) - parts, F.col("cell")) + F.col("part"))
        return cls(dealt.select("cell", "part", pack.alias("pack"), "id", "v"), centroids, reach, parts, packs)

    def probes_for(self, share: float = 0.95, k: int = 10, sample: int = SAMPLED_QUERIES) -> int:
        """How many cells to probe so that ``share`` of the exact neighbours of ``sample`` indexed vectors lie in them."""
        if not len(self.centroids):
            return 1
        picked = materialize(self.rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("id", "v"), "sampled-queries")
        exact = self.search(picked, k, probes=max(1, len(self.centroids) // 8), exact=True, id_col="id", col="v").select("query", F.col("id").alias("_i"))
        where = self.rows.select("id", "cell").join(exact, F.col("id") == F.col("_i")).select("query", "cell").toPandas()  # k rows a sampled query
        vectors = picked.toPandas()
        if not len(where):
            return 1
        order = np.argsort(-(_matrix(vectors["v"]) @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        row = {q: i for i, q in enumerate(vectors["id"])}
        ranks = np.sort([place[row[q], c] for q, c in zip(where["query"], where["cell"])])
        return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
        """The ``k`` vectors most similar to each query vector, the query's own identifier left out: query, id, similarity, rank.

        Cells near a query are looked through, ``probes`` of them; None takes as many
        as ``probes_for`` finds, or an eighth before an exact search. ``exact`` goes on
        with all cells that can hold a vector better than the k-th found so far,
        by the angle to the cell's centroid less the cell's reach; the result is
        then that of comparing all vectors. Unusable queries have no rows.
        """
        asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(col).cast("array<float>").alias("q")).where(usable(F.col("q")))
        if not len(self.centroids):
            return asked.selectExpr("query", "cast(null as long) as id", "cast(null as double) as similarity", "1 as rank").where("false")
        if probes is None:
            probes = max(1, len(self.centroids) // 8) if exact else self.probes_for(k=k)
        rounds = -(-asked.count() // ROUND)
        if rounds <= 1:
            return self._found(asked, k, probes, exact)[0]
        found = []
        for r in range(rounds):
            some, spent = self._found(asked.where(F.pmod(F.xxhash64("query", F.lit(5)), F.lit(rounds)) == r), k, probes, exact)
            found.append(materialize(some, "found"))
            discard(*spent)
        return reduce(DataFrame.unionByName, found)

    def _found(self, asked: DataFrame, k: int, probes: int, exact: bool) -> tuple[DataFrame, list[DataFrame]]:
        """The best ``k`` of queries, and the tables that were written for them."""
        met, sent = self._compared(self._sent(asked.withColumn("least", F.lit(None).cast("double")), probes), k)
        first = materialize(self._best(met, k), "probed")
        discard(sent)
        if not exact:
            return first, [first]
        found = first.groupBy("query").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
        bound = found.select(F.col("query").alias("_q"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
        more = asked.join(bound, F.col("query") == F.col("_q"), "left").select("query", "q", F.coalesce("least", F.lit(-2.0)).alias("least"))
        rest, sent = self._compared(self._sent(more, probes), k)
        return self._best(first.select("query", "id", "similarity").unionByName(rest), k), [first, sent]

    def _sent(self, asked: DataFrame, probes: int) -> DataFrame:
        """Queries by pack, with the wanted cells as bits: the ``probes`` nearest cells, or with a bound those beyond them that can hold better vectors."""
        centroids, reach, parts = self.centroids, self.reach, self.parts
        held = np.zeros((len(parts), int(self.packs.max()) + 1), np.float32)  # which packs hold a part of a cell
        held[np.repeat(np.arange(len(parts)), parts), self.packs] = 1

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for lo in range(0, len(f), 1000):
                    g = f.iloc[lo : lo + 1000]
                    s = _matrix(g["q"]) @ centroids.T
                    order = np.argsort(-s, axis=1, kind="stable")
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(g), 0), axis=1)
                    wanted = place < probes
                    if g["least"].notna().any():
                        best = np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - reach[None, :], 0))
                        wanted = ~wanted & (best >= g["least"].to_numpy()[:, None] - SLACK)
                    row, pack = np.nonzero(wanted.astype(np.float32) @ held > 0)
                    bits = np.array([x.tobytes() for x in np.packbits(wanted, axis=1)], object)
                    for a in range(0, len(row), 2000):
                        at = row[a : a + 2000]
                        yield pd.DataFrame({"pack": pack[a : a + 2000].astype(np.int32), "query": g["query"].to_numpy()[at], "q": g["q"].to_numpy()[at], "wanted": bits[at]})

        return asked.mapInPandas(choose, "pack int, query long, q array<float>, wanted binary")

    def _compared(self, sent: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The best ``k`` in the wanted cells of each pack for each query sent there (query, id, similarity), and the written table of what is sent."""
        sent = materialize(sent, "asked")
        sizes = {r["pack"]: -(-r["n"] // QUERIES) for r in sent.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pack
        shares = F.get(F.array(*[F.lit(sizes.get(p, 0)) for p in range(int(self.packs.max()) + 1)]), F.col("pack"))
        left = self.rows.where(shares > 0).select("pack", "cell", "id", "v").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
        right = sent.withColumn("share", F.pmod(F.xxhash64("query", F.lit(2)), shares).cast("int"))

        def compare(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
            if not len(vs) or not len(qs):
                return none
            vs = vs.sort_values("id", ignore_index=True)
            ids, cell, v, out = vs["id"].to_numpy(), vs["cell"].to_numpy(), _matrix(vs["v"]), [none]
            n = min(k, len(ids))
            for lo in range(0, len(qs), 256):
                at = qs["query"].to_numpy()[lo : lo + 256]
                s = _matrix(qs["q"].iloc[lo : lo + 256]) @ v.T
                wanted = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in qs["wanted"].iloc[lo : lo + 256]]), axis=1).astype(bool)
                s[~wanted[:, cell] | (at[:, None] == ids[None, :])] = -np.inf
                # Ties go to the smaller identifier, so a k-th value that several have is taken in their order.
                row, col = np.nonzero((s >= np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n, None]) & (s >= -2))
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < n
                row, col = row[first], col[first]
                out.append(pd.DataFrame({"query": at[row], "id": ids[col], "similarity": s[row, col]}))
            return pd.concat(out, ignore_index=True)

        key = ["pack", "share"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query long, id long, similarity double"), sent

    @staticmethod
    def _best(rows: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("id"))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours that an exact search gives, those of them found, and their share."""
    hit = exact.select("query", "id").join(found.select(F.col("query").alias("_q"), F.col("id").alias("_i")), (F.col("query") == F.col("_q")) & (F.col("id") == F.col("_i")), "left")
    return hit.agg(F.count(F.lit(1)).alias("neighbours"), F.count("_i").alias("found")).withColumn("recall", F.try_divide(F.col("found"), F.col("neighbours")))
