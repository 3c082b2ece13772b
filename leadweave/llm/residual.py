"""Hierarchical residual packing of whole documents into sequences of fixed length.

1. Texts become token ids where they lie; only their lengths and checksums go on. A document longer than a sequence is cut
   into full sequences, which are done, and a rest.
2. Items are dealt by hash into partitions of bounded size. Each packs its own best-fit, largest first; bins that are
   nearly full are emitted.
3. Underfull bins become items themselves: FAN partitions merge into one, which packs their bins best-fit and emits what is
   nearly full, until one partition is left or its bins don't combine any more.

Each level is a written table and orders its items by size and number, so a task that runs again after a lost executor
gives the same rows.
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

LENGTH, END = 4096, 1
#: free places up to which a bin counts as nearly full
SLACK = 32
#: items of a partition at each level, about; partitions that merge into one
ITEMS, FAN = 8192, 8
FIXED = "row long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean"
NAMES = ["id", *(c.split()[0] for c in FIXED.split(", "))]


def best_fit(size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each item: the largest first, each into the fullest bin that it fits (of equal ones the latest)."""
    order = np.argsort(-size, kind="stable")
    number, place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, made = 0, 0  # rooms: bit r is set if a bin with r free places is open
    for k, s in zip(order.tolist(), size[order].tolist()):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, made = length, made, made + 1
        number[k], place[k] = at, length - room
        if room > s:
            by_room[room - s].append(at)
            rooms |= 1 << (room - s)
    return number, place


def _items(path: str, end: int, length: int):
    """One row per piece of a document, each in a bin of its own; those of full length are done."""
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        row, made = 0, 0
        release()
        for batch in slices(batches, "text"):
            out, ids_out = [], []
            for id_, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), path)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    own = ids[start:start + length]
                    # bins of this step count down from -1, those of later levels up from 0
                    out.append((part + row, piece, start, len(own), zlib.crc32(own.tobytes()), -1 - part - made, 0, len(own) < length))
                    ids_out.append(id_)
                    made += 1
                row += 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, batch.schema.field(0).type), *columns], names=NAMES)
    return run


def _level(length: int, slack: int):
    """Best-fit over the bins of one partition, whose pieces keep their order; each bin that comes out is open if it is underfull."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        level, group = (int(k.as_py()) for k in key)
        bins, at = np.unique(rows.column("bin").to_numpy(), return_inverse=True)
        size = np.bincount(at, rows.column("length").to_numpy()).astype(np.int64)
        number, place = best_fit(size, length)
        fill = np.bincount(number, size)
        new = {"bin": pa.array((level << 56) + (group << 20) + number[at]), "offset": pa.array(place[at] + rows.column("offset").to_numpy()),
               "open": pa.array(fill[number[at]] < length - slack)}
        return pa.table([new[c] if c in new else rows.column(c) for c in NAMES], names=NAMES)
    return run


def pack_whole(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, end: int = END,
               slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with ``end``; a null or empty text is that id alone. A document of at most ``length`` ids is one piece, a
    longer one is cut into pieces of ``length`` and a last one that may be shorter. Sequences hold whole pieces, at most ``length``
    ids, and are gapless from offset 0; their ids are unique, not gapless. Null and repeated ids are rows like any other; texts of
    any length are encoded whole; other columns are not read; ties of size go by place in the table. An empty table gives no
    rows. ``tokenizer`` is a file of a byte-pair tokenizer that splits at blanks. ``items`` bounds the items of a task, not the result.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {dict(docs.dtypes)['id']}, {FIXED}"
    pieces = table(docs.mapInArrow(_items(tokenizer, end, length), schema), "pieces")
    done, rest = [pieces.where("not open")], pieces.where("open")
    bins, level, groups = rest.count(), 0, 0
    while bins:
        level += 1
        now = -(-bins // items) if level == 1 else max(-(-groups // FAN), -(-bins // items))
        if level > 1 and now >= groups:
            break  # one partition has packed all, or the bins that are left are too many for fewer partitions
        group = F.pmod(F.xxhash64("bin"), F.lit(now)) if level == 1 else F.expr(f"(shiftright(bin, 20) & {(1 << 36) - 1}) * {now} div {groups}")
        keyed = rest.withColumn("level", F.lit(level).cast("long")).withColumn("group", group.cast("long"))
        packed = table(keyed.groupBy("level", "group").applyInArrow(_level(length, slack), schema), "bins")
        done.append(packed.where("not open"))
        rest, groups = packed.where("open"), now
        # a bin's first piece stands at 0
        bins = rest.where("offset = 0").count()
    out = rest
    for part in done:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
