"""Usable embeddings, k-means on bounded samples and Arrow helpers shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str | Column, dim: int) -> Column:
    """True where a vector has ``dim`` numbers, none null, NaN or infinite, and is not all zero."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """The float lists of an Arrow column as a matrix of unit rows (float32)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Index of the closest centre (Euclidean) of each row."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; empty cells are re-seeded. Fewer rows than ``k`` give the rows themselves."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(x, centres)
        count = np.bincount(cell, minlength=k)
        order = np.argsort(cell, kind="stable")
        full = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[full]
        centres[full] = np.add.reduceat(x[order], starts, axis=0) / count[full][:, None]
        if len(full) < k:
            empty = np.flatnonzero(count == 0)
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres.astype(np.float32)


def bounded_sample(df: DataFrame, key: str, embedding: str, dim: int, rows: int, size: int) -> np.ndarray:
    """About ``size`` unit vectors of ``rows``, drawn by a hash of the key so that a rerun draws the same."""
    if not rows:
        return np.zeros((0, dim), np.float32)
    grain = 1 << 20
    keep = min(grain, -(-grain * size // rows))
    t = df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(grain)) < keep).select(embedding).limit(2 * size).toArrow()
    return unit_rows(t.column(0), dim)
