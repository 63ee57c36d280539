"""Vectors and id lists as little-endian blobs, on whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def floats_to_blob(values) -> bytes:
    return np.asarray(values, dtype="<f4").tobytes()


def blob_to_floats(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise ValueError(f"a float blob of {len(raw)} bytes")
    return np.frombuffer(raw, dtype="<f4").tolist()


def ids_to_blob(ids) -> bytes:
    """Sorted distinct 32-bit ids."""
    return np.unique(np.asarray(list(ids), dtype="<u4")).astype("<u4").tobytes()


def blob_to_ids(raw: bytes) -> list[int]:
    return np.unique(np.frombuffer(raw[: len(raw) // 4 * 4], dtype="<u4")).tolist()


@pandas_udf(T.BinaryType())
def vector_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else floats_to_blob(v))


@pandas_udf(T.ArrayType(T.FloatType()))
def blob_vector(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))
