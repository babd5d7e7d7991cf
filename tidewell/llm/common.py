"""What the operators share: the shared folder, written tables, bounded Bloom filters, byte tables."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, fresh_dir, materialize, shared_dir

__all__ = ["bloom_bits", "bloom_of", "bucketed", "discard", "fresh_dir", "given_names", "in_arrow", "in_bloom", "lower_ascii", "materialize", "mix", "read_table", "shared_dir", "shingles", "word_hashes"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Writes ``df`` to the shared folder in hash buckets of ``key``, so that joins on it read the table without a shuffle."""
    spark, name = df.sparkSession, f"tidewell_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", fresh_dir(spark, label)).bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone; the files stay
    return table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to Python at a time, where the session says nothing else; one row may have more.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, func, schema) -> DataFrame:
    """``df.mapInArrow``, by batches of BATCH_BYTES.

    Spark's own batches of whole texts take tens of MB on both sides, and an
    executor that runs stage after stage keeps much of what its largest batches
    took. The setting stays in the session, as the rows are made when they are
    asked for; one that the session has already is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(func, schema)


def given_names(columns: list[str], added: list[str]) -> list[str]:
    """The caller's column names beside an operator's own: one that clashes with these gets ``_given`` at its end."""
    taken = {a.lower() for a in added}
    return [f"{c}_given" if c.lower() in taken else c for c in columns]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Bytes between words: ASCII white space, or any ASCII byte but letters and digits.
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_RATIO = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed at a time.
_STRETCH = 1 << 20


class WordHashes:
    """64-bit hashes of a text's words, A-Z lower-cased, by numpy over all bytes at once.

    A word's hash is a polynomial in its bytes' random numbers. The sums of all
    powers up to a byte are taken once; a word's part of them is divided by the
    power of its first byte, so the same word has the same hash anywhere.
    """

    def __init__(self, between: np.ndarray):
        self.between = between
        self.value = mix(np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint64), 21)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = 1 << (n - 1).bit_length()
            for name, ratio in (("power", _RATIO), ("inverse", pow(_RATIO, -1, 1 << 64))):
                steps = np.full(n, ratio, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Hashes, first bytes and last bytes (exclusive) of the words, and the text's bytes; none for a null."""
        raw = text.encode() if text else b""
        every = np.frombuffer(raw, np.uint8)
        found, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + _STRETCH)
            while end < len(raw) and not self.between[raw[end]]:
                end += 1
            found.append((at, *self._hashes(every[at:end])))
            at = end
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), raw
        return np.concatenate([h for _, h, _, _ in found]), np.concatenate([s + o for o, _, s, _ in found]), np.concatenate([e + o for o, _, _, e in found]), raw

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.between[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = np.take(self.value, data, mode="clip")
        terms *= self.power[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends

    def __call__(self, text: str | None) -> np.ndarray:
        return self.places(text)[0]


_hashers: dict[bytes, WordHashes] = {}


def word_hashes(between: np.ndarray = SPACES) -> WordHashes:
    """This process's word hashes; a worker keeps their tables from task to task."""
    key = between.tobytes()
    if key not in _hashers:
        _hashers[key] = WordHashes(between)
    return _hashers[key]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finalizer of splitmix64 over unsigned 64-bit numbers."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(times)
    z ^= z >> np.uint64(31)
    return z


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` word hashes, in order; fewer words are one run, none give none."""
    n = len(h)
    if n == 0:
        return h
    width = min(width, n)
    # A sum of the words' hashes, each times the random odd number of its place.
    places = mix(np.arange(width, dtype=np.uint64), 31) | np.uint64(1)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * places[k]
    return mix(out, width)


BLOOM_HASHES = 3
#: Bits of a Bloom filter that tasks hold at most (32 MB), and the keys of which it lets few others through.
BLOOM_MAX_BITS = 28
BLOOM_KEYS = 1 << 25


def bloom_bits(n: int) -> int:
    """The bits, as a power of two, of a filter of n keys: eight to sixteen a key, BLOOM_MAX_BITS at most."""
    return min(BLOOM_MAX_BITS, max(16, math.ceil(math.log2(8 * max(n, 1)))))


def _bloom_shifts(bits: int) -> list[int]:
    """Where in a hash its positions begin: beside each other if they fit, else overlapping."""
    return [k * min(bits, (64 - bits) // (BLOOM_HASHES - 1)) for k in range(BLOOM_HASHES)]


def bloom_of(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A Bloom filter of a long column, as a bitmap of 2**bits bits.

    Spark sets the bits: each hash gives three positions, and words of 32 bits
    are or-ed together, so at most 2**bits / 32 rows reach the driver.
    """
    x = F.col(column)
    spots = F.explode(F.array(*[F.shiftrightunsigned(x, k).bitwiseAND((1 << bits) - 1) for k in _bloom_shifts(bits)]))
    words = (
        hashes.where(x.isNotNull())
        .select(spots.alias("spot"))
        .groupBy(F.shiftright("spot", 5).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("word"))
    )
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    rows = words.toArrow()
    bitmap[rows["at"].to_numpy()] = rows["word"].to_numpy().astype(np.uint32)
    return bitmap.tobytes()


def in_bloom(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Which of these unsigned 64-bit hashes may be in the filter (all that are in it, and a few more)."""
    words = np.frombuffer(bitmap, np.uint32)
    bits = int(len(words) * 32).bit_length() - 1
    low = np.uint64((1 << bits) - 1)
    ok = np.ones(len(h), bool)
    left = np.arange(len(h))
    for shift in _bloom_shifts(bits):
        spot = (h[left] >> np.uint64(shift)) & low
        is_set = (words[(spot >> np.uint64(5)).astype(np.int64)] >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        ok[left[~is_set]] = False
        left = left[is_set]
    return ok
