"""Token ids as sorted-string-table shards.

A shard holds documents in the order of their identifiers:

    block*  index  Bloom filter  footer

A block is a run of entries and a CRC-32. An entry is three varints (bytes of
the key shared with the entry before, other bytes of the key, number of ids),
the key's other bytes and the ids, little-endian, of the footer's width. The
first entry of a block shares nothing, so blocks can be read alone. The index
has each block's first key, offset and length; with the Bloom filter it lets a
lookup read one block at most. Numbers in the footer are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder

MAGIC = b"TWSSTBL1"
FOOTER = struct.Struct("<QQQQQQQBI8s")
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS_PER_KEY, BLOOM_PROBES = 32 << 10, 64 << 20, 10, 6
MANIFEST = "part int, seq int, shard string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes whose order is that of the identifiers, null first."""
    return b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)).to_bytes(8, "big"))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, n_bits: int) -> list[int]:
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Streams blocks to an open binary file; holds one block, the sparse index and the keys."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.n_docs = self.n_tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.block += zlib.crc32(self.block).to_bytes(4, "little")
            self.index.append((self.first, self.at, len(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    @property
    def size(self) -> int:
        return self.at + len(self.block)

    def close(self) -> int:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        n_bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = bytearray((n_bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, n_bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = index + bytes(bloom)
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), n_bits, self.n_docs, self.n_tokens, self.width, zlib.crc32(tail), MAGIC)
        self.out.write(tail + foot)
        return self.at + len(tail) + len(foot)


class Shard:
    """Reads a shard from bytes: whole, or one key by Bloom filter, binary search and one block."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")
        at, n, bloom_at, bloom_n, self.n_bits, self.n_docs, self.n_tokens, self.width, crc, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC or zlib.crc32(self.data[at : bloom_at + bloom_n]) != crc:
            raise ValueError("not a shard, or its index is damaged")
        self.bloom = self.data[bloom_at : bloom_at + bloom_n]
        self.index, end = [], at + n
        while at < end:
            k, at = _read_varint(self.data, at)
            key, at = bytes(self.data[at : at + k]), at + k
            off, at = _read_varint(self.data, at)
            size, at = _read_varint(self.data, at)
            self.index.append((key, off, size))

    def _block(self, off: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        block = self.data[off : off + size - 4]
        if zlib.crc32(block) != int.from_bytes(self.data[off + size - 4 : off + size], "little"):
            raise ValueError("a block is damaged")
        at, key, kind = 0, b"", "<u2" if self.width == 2 else "<u4"
        while at < len(block):
            shared, at = _read_varint(block, at)
            own, at = _read_varint(block, at)
            n, at = _read_varint(block, at)
            key, at = key[:shared] + bytes(block[at : at + own]), at + own
            yield key, np.frombuffer(block[at : at + n * self.width], kind)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, off, size in self.index:
            yield from self._block(off, size)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.n_bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of each document of this key, in order; none if it isn't there."""
        if not self.index or not self.may_have(key):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key isn't below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for first, off, size in self.index[max(0, lo - 1) :]:
            if first > key:
                break
            found += [ids for k, ids in self._block(off, size) if k == key]
        return found


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes each text, appends ``end_id`` and writes shards in ascending order of identifiers.

    Rows are dealt by ranges of (identifier, hash of the text) and sorted within
    a range; each task streams its range into shards of about ``shard_bytes``.
    A shard is written under a name of its attempt and then renamed, so a task
    that runs twice leaves the same files. Returns the manifest, lazily: one row
    for each shard, in the order of (part, seq).

    A null text is empty and a null identifier comes first; repeated
    identifiers and rows are kept side by side. No rows give no shards.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        task, codec = TaskContext.get(), encoder(tokenizer)
        width = 2 if codec.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, seq, writer, sink, tmp, made = task.partitionId(), 0, None, None, "", []

        def close():
            n = writer.close()
            sink.close()
            name = f"part-{part:06d}-{seq:04d}.sst"
            store.move(tmp, f"{root}/{name}")
            made.append((part, seq, name, writer.n_docs, writer.n_tokens, n))

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids_col, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids_col), 256):
                for doc_id, ids in zip(ids_col[lo : lo + 256], codec.encode(texts[lo : lo + 256].to_pylist())):
                    if writer is None:
                        tmp = f"{root}/_{task.taskAttemptId()}-{seq}.tmp"
                        sink = store.open_output_stream(tmp)
                        writer = ShardWriter(sink, width)
                    writer.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                    if writer.size >= shard_bytes:
                        close()
                        writer, seq = None, seq + 1
        if writer is not None:
            close()
        cols = list(zip(*made)) if made else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "seq", "shard", "n_docs", "n_tokens", "n_bytes"])

    return ranged.mapInArrow(write, MANIFEST)


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """All documents of a folder of shards: shard, doc_id, start (ids before it in the shard), ids (little-endian unsigned 32-bit)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").schema("path string, modificationTime timestamp, length long, content binary").load(out_dir)

    def decode(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, keys, starts, ids, before, held = [], [], [], [], 0, 0
                for key, tokens in Shard(data.as_buffer()):
                    names.append(path.rpartition("/")[2])
                    keys.append(id_of(key))
                    starts.append(before)
                    ids.append(tokens.astype("<u4").tobytes())
                    before += len(tokens)
                    held += len(ids[-1])
                    if held >= 4 << 20:
                        yield _decoded(names, keys, starts, ids)
                        names, keys, starts, ids, held = [], [], [], [], 0
                yield _decoded(names, keys, starts, ids)

    return files.select("path", "content").mapInArrow(decode, "shard string, doc_id long, start long, ids binary")


def _decoded(names, keys, starts, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "doc_id", "start", "ids"])

