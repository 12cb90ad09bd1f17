"""Vectors of `embeddings` as matrices of whole numbers inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries are clamped to what a double holds as a whole number.
MOST = float(2**53)


def whole(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has no null and no non-finite entry."""
    return df.where(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def scaled(vector: str, factor: int, plus: int = 0):
    """floor(factor * entry) + plus as longs, clamped at 2^53 either way."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * factor))) + F.lit(plus).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, fill: int = 0) -> np.ndarray:
    """Lists of longs as rows of a matrix; shorter lists are filled up."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
