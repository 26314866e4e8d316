"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import prepare


def normalised(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): each id's vector, of norm 1, as float32 bytes.

    Left out are null ids and vectors that are null, empty, zero or not finite
    in every place.  Of rows that repeat an id the greatest vector counts.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x")):
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) if x.is_valid else np.zeros(0)
                top = np.abs(v).max() if len(v) else 0.0
                if top > 0 and np.isfinite(top):
                    v = v / top
                    ids.append(i)
                    out.append((v / np.sqrt(v @ v)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where("id is not null and x is not null")
    return rows.mapInArrow(run, "id long, v binary").groupBy("id").agg(F.max("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float32) -> np.ndarray:
    """Binary vectors of one size as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray) or not len(column):  # too large for one array, or empty
        parts = [matrix(c, dtype) for c in column.chunks] if isinstance(column, pa.ChunkedArray) and len(column) else []
        return np.concatenate(parts) if parts else np.zeros((0, 0), dtype=dtype)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=dtype, offset=int(ends[0]), count=int(ends[-1] - ends[0]) // np.dtype(dtype).itemsize).reshape(len(column), -1)


def ranked(row: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best others, sorted by row and rank; of repeated pairs the first counts."""
    order = np.lexsort((other, row))
    r, o = row[order], other[order]
    order = order[np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])))[: len(order)]]
    order = order[np.lexsort((other[order], -cosine[order], row[order]))]
    r = row[order]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))[: len(r)]
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[rank < k]
