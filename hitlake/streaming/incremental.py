"""File-incremental build with Structured Streaming: the capture table drives micro-batches of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def incremental_build(
    spark: SparkSession, captures_path: str, schema: StructType, checkpoint: str, output: str, build: Callable[[DataFrame], DataFrame], files_per_batch: int = 20
) -> None:
    """Process the files not seen before, `files_per_batch` at a time, and stop.

    `build` maps the captures of a batch to training rows (it reads the hits of those files itself). Rows lie in a
    partition of their batch and split (columns `batch`, `split`). A repeated batch has its number again and overwrites its
    own partitions, so a rerun after a failure leaves no row twice. Logical files have no folders of their own here: their
    number would set the time, whatever their size. A fresh start is a new checkpoint and output folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = build(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "split").parquet(output)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(captures_path)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def remaining_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows without a finished entry (column source_file)."""
    return files.join(done.select("source_file"), "source_file", "left_anti")
