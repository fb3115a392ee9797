"""Shared plumbing: stable intermediate results, batch slicing, Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foldframe.sources.shared import shared_dir

__all__ = ["append", "column", "packed", "shared_dir", "slices", "stable", "table", "unpacked", "with_fields"]


def stable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder.

    They survive the loss of executors, and two readers see the same rows.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *ddl: str) -> T.StructType:
    """Schema plus further columns, given as DDL."""
    return T.StructType(list(schema.fields) + [f for d in ddl for f in T.StructType.fromDDL(d).fields])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about most_bytes of text; one very long text is a slice of its own.

    This bounds what a Python worker holds besides the batch itself.
    """
    for batch in batches:
        lens = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lens):
            if i > start and (held + (n or 0) > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(lens):
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def append(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """Columns keep of the batch, then more."""
    return pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + list(more.values()), names=keep + list(more))


def packed(numbers: np.ndarray) -> bytes:
    """Three bytes for each number below 2^24."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<i4").ravel()
