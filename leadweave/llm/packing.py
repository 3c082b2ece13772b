"""Bounded-space online packing of token ids into sequences of fixed length.

Each partition keeps a fixed number of open windows. A piece goes into the fullest window that it fits; if it fits none,
it fills up the fullest, which is emitted, and the rest goes on. At its end a partition merges its open windows into one.
The leftovers of partitions (less than a sequence each) are merged in further rounds of many to one, and the last one is
cut at powers of two, which need no padding.

Pieces are written before leftovers are read, and a partition's numbers derive from its place in the table, so a task that
runs again after a lost executor gives the same rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.tables import table
from leadweave.llm.tokens import encode
from leadweave.llm.words import release, slices

LENGTH, OPEN = 4096, 16
END = 2
#: leftovers merged by one task of a round
MERGE = 64
PIECE = "id {0}, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = ["id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class Windows:
    """Open windows, and the pieces of those that were emitted."""

    def __init__(self, first: int, number: int = OPEN, length: int = LENGTH):
        self.next, self.number, self.length, self.open, self.out = first, number, length, [], []

    def _emit(self, window: list) -> None:
        offset = 0
        for piece in window[1]:
            self.out.append((*piece[:5], self.next, offset, piece[5]))
            offset += len(piece[5])
        self.next += 1

    def add(self, id_, row: int, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids):
            room = [w for w in self.open if w[0] + len(ids) <= self.length]
            if room:
                best = max(room, key=lambda w: w[0])
            elif len(self.open) < self.number and len(ids) < self.length:
                best = [0, []]
                self.open.append(best)
            elif len(ids) >= self.length or not self.open:
                best = [0, []]
            else:
                best = max(self.open, key=lambda w: w[0])
            n = min(len(ids), self.length - best[0])
            best[1].append((id_, row, start, n, total, ids[:n]))
            best[0] += n
            start, ids = start + n, ids[n:]
            if best[0] == self.length:
                self._emit(best)
                self.open = [w for w in self.open if w is not best]

    def merge(self) -> None:
        """Put what is open into as few windows as can be; at most one is left."""
        rest, self.open, self.number = sorted(self.open, key=lambda w: -w[0]), [], 1
        for window in rest:
            for piece in window[1]:
                self.add(piece[0], piece[1], piece[2], piece[4], piece[5])

    def close(self) -> None:
        """Cut the last window at powers of two."""
        for window in self.open:
            pieces = list(window[1])
            left = window[0]
            while left:
                size, part, used = 1 << (left.bit_length() - 1), [], 0
                while used < size:
                    p = pieces.pop(0)
                    n = min(len(p[5]), size - used)
                    part.append((*p[:3], n, p[4], p[5][:n]))
                    used += n
                    if n < len(p[5]):
                        pieces.insert(0, (p[0], p[1], p[2] + n, len(p[5]) - n, p[4], p[5][n:]))
                self._emit([size, part])
                left -= size
        self.open = []

    def rows(self, id_type: pa.DataType, leftovers: bool) -> pa.RecordBatch:
        """Emitted pieces, and what is open as pieces without a sequence that keep their ids."""
        rows = [(*p[:4], zlib.crc32(p[7].astype("<u4").tobytes()), p[4], p[5], p[6], None) for p in self.out]
        self.out = []
        if leftovers:
            rows += [(*p[:4], None, p[4], None, None, p[5].astype("<u4").tobytes()) for w in self.open for p in w[1]]
        types = [id_type, *[pa.int64()] * 7, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=NAMES)


def _pack(path: str, open_windows: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        windows, row, kind = Windows(part << 32, open_windows), part << 32, None
        release()
        for batch in slices(batches, "text"):
            kind = batch.schema.field(0).type
            for id_, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), path)):
                ids = np.append(ids, np.uint32(END))
                windows.add(id_, row, 0, len(ids), ids)
                row += 1
            yield windows.rows(kind, False)
        if kind is not None:
            windows.merge()
            yield windows.rows(kind, True)
    return run


def _merge(last: bool):
    """Leftovers of MERGE groups into one; sequences are numbered from a place of their own, round after round."""
    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        group, first = (int(k.as_py()) for k in key)
        windows = Windows(first + (group << 20), 1)
        batch = batch.sort_by([("row", "ascending"), ("start", "ascending")])
        kind = batch.schema.field("id").type
        for id_, row, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "start", "doc_tokens", "ids"))):
            windows.add(id_, row, start, total, np.frombuffer(ids, "<u4"))
        if last:
            windows.close()
        return pa.Table.from_batches([windows.rows(kind, True)])
    return run


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", open_windows: int = OPEN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's ids end with END; a null or empty text is END alone. Each id lies in one piece; sequences hold at most LENGTH
    ids, full but for the last few, whose lengths are powers of two. Sequence ids are unique, not gapless. Null and repeated ids
    are rows like any other. Other columns are not read. An empty table gives no rows. ``tokenizer`` is a file of a
    byte-pair tokenizer that splits at blanks (checked on no text: choose ``word_bpe_49k.json``).
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = PIECE.format(dict(docs.dtypes)["id"])
    pieces = table(docs.mapInArrow(_pack(tokenizer, open_windows), schema), "pieces")
    done, rest = [pieces.where("sequence_id is not null")], pieces.where("sequence_id is null")
    rounds = 0
    # partitions are numbered from 0; each round leaves one leftover for MERGE of them
    top = rest.agg(F.max(F.shiftright("row", 32))).first()[0]
    shift = 0
    while top is not None:
        shift, rounds = shift + MERGE.bit_length() - 1, rounds + 1
        last = top >> shift == 0
        keyed = rest.withColumn("group", F.shiftright("row", 32 + shift)).withColumn("first", F.lit(rounds << 56))
        merged = table(keyed.groupBy("group", "first").applyInArrow(_merge(last), schema), "pieces")
        done.append(merged.where("sequence_id is not null"))
        rest = merged.where("sequence_id is null")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_column), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
