"""Hard negatives by a secondary-sort shuffle.

1. Rows and anchors are dealt into blocks that meet on a grid. Each cell of it gives an anchor's best rows of its own label
   there; the best of all cells are its positives.
2. The blocks meet again, now with the scores of the positives. Each cell gives, for each anchor and positive, the first
   rows of other labels in its window: no other row of the cell can be among the first of all.
3. Positives and these rows get the key (anchor, descending score, positives first, id). One shuffle deals them by anchor and
   sorts each partition by the key; an iterator over the sorted rows opens a window at each positive, writes negatives into
   the open windows, and closes them. It holds the open windows of one anchor, never an anchor's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from leadweave.llm.tables import table
from leadweave.llm.vectors import compact, matrix, products, whole_matrices
from leadweave.llm.words import release

POSITIVES, NEGATIVES = 5, 5
#: a negative's score is at least this many hundredths of its positive's
PERCENT = 80
#: rows and anchors that meet in a cell of the grid, about; rows of a block
ROWS, ANCHORS, SIZE = 8_192, 1_024, 1_024
BLOCK = "block long, dim int, n int, ids binary, labels binary, x binary, windows binary"
FOUND = "anchor long, score long, id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NONE = np.iinfo(np.int64).min


def _blocks(scale: int):
    """Blocks of up to SIZE rows of (id, label, vector, scores of positives), all of one length."""
    def run(batches):
        release()
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, labels, x, windows = (np.concatenate([p[k] for p in parts]) for k in range(4))
            values = [int(ids[0]), dim, len(ids), ids.tobytes(), labels.tobytes(), compact(x), windows.tobytes()]
            types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(False) for k in (0, 1))
            told = batch.column(3).to_pylist()
            windows = np.full((batch.num_rows, max(map(len, told), default=0)), NONE)
            for k, scores in enumerate(told):
                windows[k, :len(scores)] = scores
            for rows, x in whole_matrices(batch.column(2), scale):
                dim = x.shape[1]
                for at in range(0, len(rows), SIZE):
                    part = rows[at:at + SIZE]
                    if sum(len(p[0]) for p in held.get(dim, [])) + len(part) > SIZE:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[part], labels[part], x[at:at + SIZE], windows[part]))
        for dim in list(held):
            yield block(dim)
    return run


def _unpack(blocks: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids, labels, vectors and windows of all rows of some blocks, by id: ties of a score fall to the smaller one."""
    parts = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), matrix(r["x"], r["n"], r["dim"]),
              np.frombuffer(r["windows"], np.int64).reshape(r["n"], -1)) for r in blocks.to_pylist()]
    by_id = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
    return tuple(np.concatenate([p[k] for p in parts])[by_id] for k in range(4))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k different (score, id) of rows in order."""
    out: list[tuple[int, int]] = []
    for pair in zip(score.tolist(), ids.tolist()):
        if not out or out[-1] != pair:
            if len(out) == k:
                break
            out.append(pair)
    return out


def _cell(negatives: bool, k: int, percent: int):
    """What one cell of the grid gives: an anchor's first rows of its label, or those of other labels in each of its windows."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: set[tuple[int, int, int]] = set()
        if rows.num_rows and anchors.num_rows:
            ids, labels, x, _ = _unpack(rows)
            anchor, label, own, windows = _unpack(anchors)
            for begin in range(0, len(anchor), 64):
                for i, score in enumerate(products(own[begin:begin + 64], x), begin):
                    alike = labels == label[i]
                    at = np.flatnonzero((~alike if negatives else alike) & (ids != anchor[i]))
                    at = at[np.argsort(-score[at], kind="stable")]
                    less = -score[at]
                    for p in set(windows[i].tolist()) - {NONE} if negatives else [None]:
                        # whole numbers: 100 * score >= percent * p is score >= the quotient rounded up
                        lo, hi = (0, len(at)) if p is None else (np.searchsorted(less, -p, "left"), np.searchsorted(less, -percent * p // 100, "right"))
                        out.update((int(anchor[i]), *f) for f in _first(-less[lo:max(lo, hi)], ids[at[lo:max(lo, hi)]], k))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "score", "id"])
    return run


def _grid(rows: DataFrame, anchors: DataFrame, parts: tuple[int, int], scale: int, cell) -> DataFrame:
    """(anchor, score, id) of all cells: each block of rows goes to every part of the anchors, each block of anchors to every part of the rows."""
    keys = ["row_part", "anchor_part", "dim"]
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.mapInArrow(_blocks(scale), BLOCK).withColumn("row_part", deal(parts[0])).withColumn("anchor_part", every(parts[1]))
    right = anchors.mapInArrow(_blocks(scale), BLOCK).withColumn("anchor_part", deal(parts[1])).withColumn("row_part", every(parts[0]))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, FOUND).distinct()


def _mine(positives: int, negatives: int, percent: int):
    """Negatives from rows (anchor, less, kind, id) sorted by all four; kind 0 is a positive, 1 another label's row."""
    def run(batches):
        anchor, windows = None, []  # open windows: positive, its score, negatives so far
        for batch in batches:
            out = []
            for now, less, kind, id_ in zip(*(c.to_pylist() for c in batch.columns)):
                if now != anchor:
                    anchor, windows = now, []
                score = -less
                if kind == 0:
                    windows.append([id_, score, 0])
                    continue
                windows = [w for w in windows if w[2] < negatives and 100 * score >= percent * w[1]]
                for w in windows:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], id_, w[1], score))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=[c.split()[0] for c in MINED.split(", ")])
    return run


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT,
                   id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor and positive.

    Components are floor(scale * x) in whole numbers, scores exact products with the anchor (cut to 64 bits). Of the rows of the anchor's
    label the ``positives`` of highest score are its positives, ties by smaller id. For each of them the first ``negatives`` rows of other
    labels, by the same order, with percent * positive_score <= 100 * negative_score <= 100 * positive_score come in ranks from 1; fewer
    rows give fewer results, none give none. Rows with a null id, label or vector, or with null or non-finite components, take no part. Rows
    of the anchor's own id are neither, rows of another length are not compared, rows equal in id and score count once. Anchors
    that share an id count once, with the smallest label and vector. Labels are whole numbers. Other columns are not read; empty
    tables give no rows.
    """
    pick = lambda df: (df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"))
                       .where("id is not null and label is not null and v is not null"))
    rows, asked = pick(vectors), pick(anchors).where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    asked = table(asked.groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v"), "anchors")
    parts = (max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // ANCHORS)))
    none = F.array().cast("array<bigint>").alias("windows")
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    alike = _grid(rows.select("*", none), asked.select("*", none), parts, scale, _cell(False, positives, percent))
    alike = table(alike.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).select("anchor", "score", "id"), "positives")
    windows = alike.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("windows")).withColumnRenamed("anchor", "id")
    others = _grid(rows.select("*", none), asked.join(windows, "id"), parts, scale, _cell(True, negatives, percent))
    key = lambda df, kind: df.select("anchor", (-F.col("score")).alias("less"), F.lit(kind).alias("kind"), "id")
    keyed = key(alike, 0).unionByName(key(others, 1))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "anchor").sortWithinPartitions("anchor", "less", "kind", "id").mapInArrow(_mine(positives, negatives, percent), MINED)
