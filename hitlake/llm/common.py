"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.sources.scratch import materialise, scratch  # noqa: F401  used by the operators

#: White space of the text contracts: space and \x09-\x0D (ASCII only), as a Java regex.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, without a copy: (all bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of their keys: the same ones on every run.

    A share of the hash range is cut off first, so the tasks together hand on about twice that many rows, not each task
    `rows` of its own.
    """
    total = df.count()
    place = (F.xxhash64(*keys).cast("double") + 2.0**63) / 2.0**64
    near = df.where(place <= 2.0 * rows / total) if total > 2 * rows else df
    return near.orderBy(F.xxhash64(*keys), *keys).limit(rows)
