"""Captures and hits as tables bucketed by capture key: the join of every later run needs no shuffle of the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hitlake.schema import KEY


def write(rows: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Write rows under a path as a table of `buckets` files, sorted by the keys, and return that table.

    Two tables of the same keys and number of buckets are joined, and each of them deduplicated or grouped by the keys,
    bucket by bucket where they lie. Hits are shuffled once, here, so that a bucket is one file.
    """
    spread = rows.repartition(buckets, *keys)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)
