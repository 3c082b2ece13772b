"""Exact nearest rows by inner product with a vector-approximation file.

Rows are dealt into blocks that hold four-bit cells of each component beside the exact vectors. For a query the cells give
bounds of every score; rows whose upper bound lies below the k-th lower bound of different ids are out, and the exact vectors of the others are
read in the order of their bounds until the k-th result is certain. Blocks of queries and of rows meet on a grid whose cells
have a bounded size; each gives k rows per query, which are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from leadweave.llm.tables import table

K = 5
CELLS = 16
#: rows of a block, and queries in a part of the grid
ROWS, QUERIES = 16_384, 8_192
BLOCK = "part int, dim int, n int, ids binary, lo binary, width binary, cells binary, exact binary"


def whole_numbers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows without null or non-finite components, and floor(scale * x) of each."""
    kept, out = [], []
    for k, v in enumerate(vectors):
        if v.is_valid and v.values.null_count == 0:
            x = np.floor(scale * np.asarray(v.values, np.float64))
            if np.isfinite(x).all():
                kept.append(k)
                out.append(x)
    return np.array(kept, np.int64), out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers held as float64, cut to the range of 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2 ** 52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest value and cell width of each component, and each row's cells, two in a byte."""
    if not x.size:
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(0, np.uint8)
    lo = x.min(0)
    width = np.ceil((x.max(0) - lo + 1) / CELLS)
    c = ((x - lo) // width).astype(np.uint8)
    c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
    return lo, width, c[:, ::2] << 4 | c[:, 1::2]


def _blocks(scale: int, rows: int, parts: int):
    def run(batches):
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, x = (np.array(c) for c in zip(*held.pop(dim)))
            x = x.reshape(len(ids), dim)
            lo, width, cells = cells_of(x)
            part = int(ids[0] * 2654435761 % parts) if len(ids) else 0
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                *(pa.array([a.tobytes()], pa.binary()) for a in (ids.astype(np.int64), lo, width, cells, x.astype(np.float32 if np.abs(x).max(initial=0) < 2 ** 24 else np.float64)))],
                names=["part", "dim", "n", "ids", "lo", "width", "cells", "exact"])

        for batch in batches:
            kept, vectors = whole_numbers(batch.column(1), scale)
            for i, x in zip(batch.column(0).to_numpy(False)[kept], vectors):
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == rows:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)
    return run


def _unpack(r: dict, exact: str = "exact") -> tuple[np.ndarray, np.ndarray]:
    n, dim, raw = r["n"], r["dim"], r[exact]
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def best_rows(query_ids: np.ndarray, queries: np.ndarray, r: dict, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score): the k best rows of one block for each query, ties to the smaller id."""
    ids, exact = _unpack(r)
    n, dim = r["n"], r["dim"]
    lo, width = np.frombuffer(r["lo"]), np.frombuffer(r["width"])
    packed = np.frombuffer(r["cells"], np.uint8).reshape(n, -1)
    cells = np.stack([packed >> 4, packed & 15], 2).reshape(n, -1)[:, :dim]
    floor = lo + cells * width
    # the bound counts ids, not rows: k rows of one id may be one result
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[:1]] - 1)) if n else by_id
    out = []
    for begin in range(0, len(queries), 128):
        q = queries[begin:begin + 128]
        base = q @ floor.T
        # rounding of the bounds themselves, far below one unit for usual values
        slack = np.abs(q).sum(1) * np.abs(floor).max(initial=1) * 1e-12
        low = np.minimum(q, 0) @ (width - 1) - slack
        high = np.maximum(q, 0) @ (width - 1) + slack
        for j, (own, x, b) in enumerate(zip(query_ids[begin:begin + 128], q, base)):
            b = np.where(ids == own, -np.inf, b)
            if len(first) > k:
                each = b if len(first) == n else np.maximum.reduceat(b[by_id], first)
                kth = np.partition(each, len(first) - k)[len(first) - k] + low[j]
                rows = np.flatnonzero(b + high[j] >= kth)
            else:
                rows = np.arange(n)
            rows = rows[ids[rows] != own]
            rows = rows[np.argsort(-b[rows], kind="stable")]
            found: dict[tuple[int, int], None] = {}
            for at in range(0, len(rows), 64):
                if len(found) >= k and b[rows[at]] + high[j] < sorted((s for s, _ in found), reverse=True)[k - 1]:
                    break
                part = rows[at:at + 64]
                found.update(dict.fromkeys(zip(products(x[None], exact[part])[0].tolist(), ids[part].tolist())))
                found = dict.fromkeys(sorted(found, key=lambda f: (-f[0], f[1]))[:k])
            out += [(int(own), i, s) for s, i in found]
    return out


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            for q in queries.to_pylist():
                out += best_rows(*_unpack(q), r, k)
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query, ranks from 1.

    Components are floor(scale * x) in whole numbers, products exact (cut to 64 bits). Ties go to the smaller id. Fewer than k
    rows give fewer results. Rows of a query's own id are not its results; repeated rows count once. Rows whose id or vector is
    null or holds null or non-finite components take no part, and rows of another length than a query's are not compared
    with it. Other columns are not read. Empty tables give no rows.
    """
    pick = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id is not null and v is not null")
    n_rows, n_queries = vectors.count(), queries.count()
    row_parts, query_parts = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))
    rows = (pick(vectors).mapInArrow(_blocks(scale, ROWS, row_parts), BLOCK)
            .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))))
    asked = (pick(queries).mapInArrow(_blocks(scale, 512, query_parts), BLOCK).drop("lo", "width", "cells").withColumnRenamed("part", "query_part")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1)))))
    keys = ["part", "query_part", "dim"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = table(found, "nearest")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
