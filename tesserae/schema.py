"""Chunks: one row per block of an array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block with its type and shape; data are little-endian, in row-major order.
CHUNK = "struct<dtype: string, shape: array<int>, data: binary>"


def chunk(data: Column, dtype: str, shape: tuple[int, ...] | None = None) -> Column:
    """A chunk from raw bytes; without a shape, one dimension."""
    size = np.dtype(dtype).itemsize
    dims = F.array(*[F.lit(n) for n in shape]) if shape else F.array((F.octet_length(data) / size).cast("int"))
    return F.when(data.isNotNull(), F.struct(F.lit(dtype).alias("dtype"), dims.cast("array<int>").alias("shape"), data.cast("binary").alias("data")))


def to_array(c: dict) -> np.ndarray:
    return np.frombuffer(c["data"], np.dtype(c["dtype"]).newbyteorder("<")).reshape(c["shape"])


def from_array(x: np.ndarray) -> dict:
    x = np.ascontiguousarray(x)
    return {"dtype": x.dtype.str[1:], "shape": list(x.shape), "data": x.astype(x.dtype.newbyteorder("<")).tobytes()}
