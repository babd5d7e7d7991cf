"""Bounded-space online packing of token ids into windows.

Each task keeps a fixed number of open windows. A document's ids are cut at the
window size; what remains goes to the open window that it fills best. If it
fits in none, it fills up the fullest, which is emitted, and its rest is placed
anew. At the end of a task the open windows are left over; they are merged,
best fit first, in groups of tasks of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize
from .encode import encoder

WINDOW, OPEN, GROUP = 1024, 8, 64
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part int, is_open boolean"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Packer:
    """The open windows of one task: ``add`` returns the pieces of windows that were emitted, ``rest`` those of all others."""

    def __init__(self, part: int, window: int = WINDOW, slots: int = OPEN):
        self.part, self.window, self.slots = part, window, slots
        self.seq = 0
        self.open: list[list] = []  # [used, sequence_id, pieces]

    def _window(self) -> list:
        w = [0, (self.part << 33) + self.seq, []]
        self.seq += 1
        return w

    def _put(self, w: list, piece: tuple[int, int], doc: int) -> None:
        w[2].append((doc, *piece, w[0]))
        w[0] += piece[1]

    def add(self, doc: int, n: int) -> list[list]:
        """Places ``n`` ids of a document (any handle); the emitted windows."""
        done, start = [], 0
        while n - start >= self.window:
            w = self._window()
            self._put(w, (start, self.window), doc)
            done.append(w)
            start += self.window
        while start < n:
            left = n - start
            fits = [w for w in self.open if self.window - w[0] >= left]
            if fits:
                w = max(fits, key=lambda w: w[0])
                self._put(w, (start, left), doc)
                start = n
            elif len(self.open) < self.slots:
                w = self._window()
                self.open.append(w)
                self._put(w, (start, left), doc)
                start = n
            else:
                w = max(self.open, key=lambda w: w[0])
                take = self.window - w[0]
                self._put(w, (start, take), doc)
                start += take
            if w[0] == self.window:
                self.open.remove(w)
                done.append(w)
        return done

    def rest(self) -> list[list]:
        return self.open


def merge_windows(used: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Best fit, largest first: for each window the one whose place it joins, and the offset there."""
    bins: list[list[int]] = []  # [room, first, used]
    out = [(0, 0)] * len(used)
    for i in sorted(range(len(used)), key=lambda i: (-used[i], i)):
        fits = [b for b in bins if b[0] >= used[i]]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            b = [window, i, 0]
            bins.append(b)
        out[i] = (b[1], b[2])
        b[0] -= used[i]
        b[2] += used[i]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, slots: int = OPEN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents placed in windows of ``window`` ids.

    One row for each piece: doc_id, start (ids of the document before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset there. Each id of each document, ``end_id`` after its text included,
    is in one piece; the pieces of a window follow each other without a gap.

    No document is shuffled: a task packs its own rows. The pieces are written
    once to the shared folder; then only the pieces of left-over windows, at
    most ``slots`` windows a task, are joined with the places they move to.

    A null text is empty, so it is its end id alone. Null and repeated
    identifiers are packed row by row. No rows give no pieces. Other columns of
    ``docs`` are left out. Of open windows that a piece fills equally well, the
    one that was opened first takes it; of left-over windows, the fuller and
    then the one of the smaller number is merged first.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def place(batches):
        codec, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        packer, out, held = Packer(part, window, slots), [], 0

        def take(windows, is_open):
            size = 0
            for _, seq, pieces in windows:
                for (doc_id, ids), start, n, at in pieces:
                    cut = ids[4 * start : 4 * (start + n)]
                    size += len(cut) + 64
                    out.append((doc_id, start, n, cut, len(ids) // 4, seq, at, part, is_open))
            return size

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)
            out.clear()
            return made

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(doc_ids), 64):
                for doc_id, ids in zip(doc_ids[lo : lo + 64], codec.encode(texts[lo : lo + 64].to_pylist())):
                    ids += end
                    held += take(packer.add((doc_id, ids), len(ids) // 4), False)
                if held >= 4 << 20:
                    yield batch()
                    held = 0
        take(packer.rest(), True)
        if out:
            yield batch()

    pieces = materialize(in_arrow(rows, place, PIECES), "pieces")
    left = pieces.where("is_open").groupBy("part", "sequence_id").agg(F.sum("length").cast("long").alias("used"))

    def merge(pdf):
        pdf = pdf.sort_values("sequence_id", ignore_index=True)
        to = merge_windows(pdf["used"].tolist(), window)
        pdf["to_id"] = [pdf["sequence_id"][i] for i, _ in to]
        pdf["shift"] = [at for _, at in to]
        return pdf[["sequence_id", "to_id", "shift"]]

    places = (
        left.withColumn("batch", F.floor(F.col("part") / GROUP).cast("long"))
        .groupBy("batch")
        .applyInPandas(merge, "sequence_id long, to_id long, shift long")
    )
    moved = (
        pieces.where("is_open")
        .join(places, "sequence_id")
        .withColumns({"sequence_id": F.col("to_id"), "offset": F.col("offset") + F.col("shift")})
    )
    cols = _NAMES[:7]
    return pieces.where("not is_open").select(cols).unionByName(moved.select(cols))
