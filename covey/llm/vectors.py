"""Vectors of a table as bytes, without those that have no direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType


def directed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): rows with an id and a vector without null or non-finite components that isn't zero.

    x holds the components as they are, in little-endian single or double precision; -0.0 becomes 0.0.
    """
    double = isinstance(vectors.schema[vector_column].dataType.elementType, DoubleType)
    kind = np.dtype("<f8") if double else np.dtype("<f4")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind) + kind.type(0)  # nulls are NaN
            length = np.asarray(lists.value_lengths().fill_null(0))
            end = np.cumsum(length)
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            some = np.r_[0, np.cumsum(values != 0)]
            good = np.flatnonzero((bad[end] == bad[end - length]) & (some[end] > some[end - length]) & np.asarray(batch.column(0).is_valid()))
            rows = [values[end[k] - length[k] : end[k]].tobytes() for k in good]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(length[good].astype(np.int32)), pa.array(rows, pa.binary())], ["vec_id", "dim", "x"])

    schema = StructType([StructField("vec_id", vectors.schema[id_column].dataType), StructField("dim", IntegerType()), StructField("x", BinaryType())])
    return vectors.select(id_column, vector_column).mapInArrow(pick, schema)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column of bytes in double precision."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(rows), "<f8" if len(rows[0]) == 8 * dim else "<f4").reshape(-1, dim).astype(np.float64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, scaled so that neither large nor small components leave the range of doubles."""
    top = np.abs(x).max(axis=1, initial=0.0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, so cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of matching rows, in double precision; the same for equal rows wherever they stand."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
