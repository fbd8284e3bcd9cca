"""Embedding columns as plain bytes, for numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_type(embeddings: DataFrame, column: str = "embedding") -> str:
    """numpy's type for the stored components: float stays float, all else is double."""
    kind = embeddings.schema[column].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def usable_vector():
    """Whether a vector has components, all of them finite and not all zero; never null."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def as_bytes(lists: pa.Array, dtype: str) -> pa.Array:
    """Each list's values as bytes."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def matrix(raw: pa.Array, dtype: str) -> np.ndarray:
    """Equal-length byte rows as a matrix of doubles."""
    rows = raw.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))
