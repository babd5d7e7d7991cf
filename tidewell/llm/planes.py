"""Centroid clustering of whole-number vectors by bit planes.

A vector's components are written plane by plane: bit b of 64 components is one
unsigned 64-bit word. A dot product is then a weighted sum of the set bits that
two planes share, over all pairs of planes, so dot products, squared distances
and sums are exact whole numbers. Tasks hold the centroids, whose number is a
parameter; what they hand on is one row for each centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def whole(col: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as double."""
    return F.transform(col, lambda x: F.floor(x.cast("double") * scale))


def usable(col: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none null, NaN or infinite."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) == size) & finite, F.lit(False))


def weights(planes: int) -> np.ndarray:
    """What a set bit of each plane counts: powers of two, the last one negative (two's complement)."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (n, planes, words) of whole numbers (n, size)."""
    n, size = values.shape
    words = -(-size // 64)
    bits = ((values[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1).astype(np.uint8)
    if size < 64 * words:
        bits = np.concatenate([bits, np.zeros((n, planes, 64 * words - size), np.uint8)], axis=2)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def from_planes(planes: np.ndarray, size: int) -> np.ndarray:
    """The whole numbers (n, size) of bit planes."""
    bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little")[:, :, :size].astype(np.int64)
    return np.einsum("b,nbs->ns", weights(planes.shape[1]), bits)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products (n, k) of vectors in planes (n, planes, words) and (k, planes, words): weighted counts of common bits."""
    w = weights(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            common = np.bitwise_count(a[:, None, i, :] & b[None, :, j, :]).sum(axis=2, dtype=np.int64)
            out += w[i] * w[j] * common
    return out


def assign(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and its squared distance."""
    own = np.array([dots(c[None], c[None])[0, 0] for c in centroids], np.int64)
    d = norms[:, None] - 2 * dots(vectors, centroids) + own[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


class _Packed:
    """How a packed table's cells are read: planes of one vector as bytes."""

    def __init__(self, planes: int, words: int):
        self.planes, self.words = planes, words

    def __call__(self, cells) -> np.ndarray:
        return np.frombuffer(b"".join(cells), np.uint64).reshape(-1, self.planes, self.words)


def pack(vectors: DataFrame, id_col: str, col: str, size: int, scale: int) -> tuple[DataFrame, int]:
    """The usable vectors as a written table (vec_id, norm, planes) and the number of planes.

    Components must be so small that a squared distance fits a long; a table
    with greater ones is an ArithmeticError, as overflows are in Spark's SQL.
    """
    kept = vectors.where(usable(F.col(f"`{col}`"), size)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole(F.col(f"`{col}`"), scale).alias("v"))
    widest = kept.select(F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x)))).alias("m")).agg(F.max("m").alias("m")).first()["m"]
    planes = int(widest or 0).bit_length() + 1
    if size * 4**planes >= 1 << 63:
        raise ArithmeticError(f"components of {planes} bits: squared distances don't fit a long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.stack(f["v"]).astype(np.int64)
                cells = to_planes(v, planes)
                yield pd.DataFrame({"vec_id": f["vec_id"], "norm": (v * v).sum(axis=1), "planes": [c.tobytes() for c in cells]})

    return materialize(kept.mapInPandas(run, "vec_id long, norm long, planes binary"), "planes"), planes


def _totals(packed: DataFrame, centroids: np.ndarray, size: int) -> list[tuple[int, int, list[int]]]:
    """Each centroid's vectors: their number, their distances' sum and their componentwise sums, exact.

    A task adds up its batches and hands on a row for each centroid, so a hot
    one isn't a hot key; the driver gets a row for each centroid.
    """
    k, planes, words = centroids.shape
    read = _Packed(planes, words)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, far, bits = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, planes * words * 64), np.int64)
        for f in frames:
            if len(f):
                v = read(f["planes"])
                best, d = assign(v, f["norm"].to_numpy(np.int64), centroids)
                n += np.bincount(best, minlength=k)
                np.add.at(far, best, d)
                # Set bits of each plane by centroid; counts below 2**53 are exact in doubles.
                one = np.zeros((k, len(v)))
                one[best, np.arange(len(v))] = 1
                bits += (one @ np.unpackbits(v.view(np.uint8), axis=2, bitorder="little").reshape(len(v), -1)).astype(np.int64)
        sums = np.einsum("b,kbs->ks", weights(planes), bits.reshape(k, planes, words * 64))[:, :size]
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "far": far[some], "sums": list(sums[some])})

    part = packed.select("norm", "planes").mapInPandas(run, "cluster int, n long, far long, sums array<long>")
    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)])
    rows = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), sums.alias("sums")).collect()
    out = [(0, 0, [0] * size)] * k
    for r in rows:
        out[r["cluster"]] = (r["n"], r["far"], list(r["sums"]))
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Nearest of ``k`` centroids for each usable vector, after ``rounds`` of exact k-means over floor(scale * x).

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid, the components of the vector's final centroid. Centroids start as
    the vectors with the smallest digests of seed and identifier, and become the
    floors of their vectors' means; one without vectors stays.

    Vectors of another length, or with a null, NaN or infinite component, and
    null vectors are left out. A null identifier is an empty word in the digest.
    Rows repeated in identifier and vector count as often as they occur; of
    equal digests the smaller vector in bytes comes first. Fewer vectors than
    ``k`` give as many centroids, and none give no rows. Other columns play no
    part. Tasks hold the centroids, so ``k`` is what bounds their memory.
    """
    packed, planes = pack(vectors, id_col, col, size, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = packed.select("planes", digest.alias("h")).orderBy("h", "planes").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not seeds:
        return packed.sparkSession.createDataFrame([], schema)
    words = -(-size // 64)
    read = _Packed(planes, words)
    centroids = read([bytes(s["planes"]) for s in seeds])
    for _ in range(rounds):
        old = from_planes(centroids, size)
        new = [[s // n for s in sums] if n else old[c].tolist() for c, (n, _, sums) in enumerate(_totals(packed, centroids, size))]
        centroids = to_planes(np.array(new, np.int64), planes)
    far = [d for _, d, _ in _totals(packed, centroids, size)]
    total, final = sum(far), from_planes(centroids, size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                best, d = assign(read(f["planes"]), f["norm"].to_numpy(np.int64), centroids)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": best.astype(np.int32), "distance": d, "cluster_inertia": np.array(far, np.int64)[best], "inertia": total, "centroid": list(final[best])})

    return packed.mapInPandas(run, schema)
