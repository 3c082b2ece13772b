"""Vectors of an Arrow list column as matrices of whole numbers, and their exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_matrices(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that occurs: floor(scale * x) of the vectors without null or non-finite components."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    x = np.floor(scale * pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(False))
    length = np.maximum(size, 0)
    begin = np.cumsum(length) - length
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    fine = (size >= 0) & (bad[begin + length] == bad[begin])
    for dim in np.unique(size[fine]):
        rows = np.flatnonzero(fine & (size == dim))
        yield rows, x[begin[rows][:, None] + np.arange(dim)]


def compact(x: np.ndarray) -> bytes:
    """The matrix as 32-bit floats if they hold its whole numbers, else as 64-bit ones."""
    return x.astype(np.float32 if np.abs(x).max(initial=0) < 2 ** 24 else np.float64).tobytes()


def matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    """What ``compact`` wrote."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers held as float64, cut to the range of 64 bits (both ends alike)."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2 ** 52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, 1 - 2 ** 63, 2 ** 63 - 1).astype(np.int64)
