"""What the operators on embeddings share: whole-number vectors, and exact sums of their products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Below this, whole numbers are exact as doubles.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def whole(table: DataFrame) -> DataFrame:
    """vec_id, label, q: floor(256 * x) of each component, which a long bounds; rows whose vector is null or holds a null or a component
    that isn't finite go."""
    v = column(table, "embedding", "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.floor(F.lit(256.0) * x).cast("bigint"))
    return table.where(v.isNotNull() & finite).select(column(table, "vec_id", "bigint").alias("vec_id"), column(table, "label", "bigint").alias("label"), q.alias("q"))


def width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("q"))).head()[0] or 0


def matrix(vectors: pa.ListArray, wide: int) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (sizes == wide).all():
        return flat.reshape(len(vectors), wide)
    out = np.zeros((len(vectors), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def most(x: np.ndarray) -> float:
    """The largest magnitude."""
    return float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0


def long(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any kind as longs; those beyond a long become the nearest long."""
    return np.clip(x, -LONG, LONG).astype(np.int64) if x.dtype == object else x.astype(np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole inner product of each row of a with the same row of b, however large."""
    if a.shape[1] * most(a) * most(b) < LONG / 2:
        return np.einsum("ij,ij->i", a, b)
    return long((a.astype(object) * b.astype(object)).sum(1)) if len(a) else np.empty(0, np.int64)
