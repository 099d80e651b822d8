"""Vector tables as rows (vec_id, v): little-endian doubles. Vectors that are null or hold null or non-finite components go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "vec_id long, v binary"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, out = [], []
        for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
            if i is not None and x.is_valid and not x.values.null_count:
                v = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])


def finite_vectors(table: DataFrame) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(parsed, SCHEMA)


def matrix(column, kind: str = "<f8", width: int = 0) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    rows = [np.frombuffer(x, kind) for x in column]
    width = max([width, *(len(r) for r in rows)])
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
