"""Sinks: splits, dictionaries, reports, and reading a training set back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_split(splits: DataFrame, path: str, seed: int, fraction: float) -> None:
    """A saved split wins over a new seed or fraction, so both are kept with it."""
    splits.withColumn("seed", F.lit(seed)).withColumn("val_fraction", F.lit(fraction)).write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """One JSON object name -> id, as `readers.read_dictionary` reads it. A dictionary is a small table."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "id"))))
    dictionary.agg(F.to_json(entries).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A small result table as JSON lines in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_ordered(rows: DataFrame, path: str, *order: str) -> None:
    """Rows in an order that lasts: ranges of it in numbered files, each sorted. `readers.read_ordered` gives the places back."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A table with a folder a file: its folders are listed by a few tasks a core, not by one each, as is Spark's default for thousands."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(LISTING, before)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a training set; both splits have to be there."""
    rows = read_partitioned(spark, path)
    found = {m[1] for f in rows.inputFiles() if (m := re.search(r"/split=([^/]+)/", f))} or {r["split"] for r in rows.select("split").distinct().collect()}
    if missing := {"train", "validation"} - found:
        raise FileNotFoundError(f"{path} has no {' or '.join(sorted(missing))} rows")
    return rows


def append_record(record: DataFrame, path: str, fresh: bool = False) -> None:
    """Add a run's rows (source_file, status, rows_train, rows_validation, reason) to the record of all runs."""
    record.withColumn("run_at", F.current_timestamp()).write.mode("overwrite" if fresh else "append").parquet(path)


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every file."""
    rows = spark.read.parquet(path)
    state = F.struct(*[c for c in rows.columns if c not in ("source_file", "run_at")])
    return rows.groupBy("source_file").agg(F.max_by(state, "run_at").alias("_s")).select("source_file", "_s.*")
