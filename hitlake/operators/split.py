"""Grouped train/validation split of exact size, its reuse, and training weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT = ("file_idx", "evtid")


def group_split(captures: DataFrame, fraction: float = 0.2, seed: int = 42, event: tuple[str, ...] = EVENT) -> DataFrame:
    """(event, split): the first floor(n (1 - fraction)) events in md5 order train, all captures of an event together.

    The rank is taken in two levels, so no window sees all events: by the first four hex digits of the hash, whose
    65,536 bucket counts are summed up, and inside each bucket.
    """
    events = captures.select(*event).distinct()
    hashed = events.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in event])))
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, 4))
    buckets = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    whole = Window.orderBy("_bucket")  # over at most 65,536 buckets
    buckets = buckets.select("_bucket", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    ranked = hashed.join(buckets, "_bucket").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *event)))
    train = F.col("_rank") <= F.floor(F.col("_total") * (1 - F.lit(fraction)) + 1e-9)
    return ranked.select(*event, F.when(train, "train").otherwise("validation").alias("split"))


def reuse_split(captures: DataFrame, saved: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Captures with the saved split; those it does not know train."""
    return captures.join(saved.select(*keys, "split"), list(keys), "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stale_rows(saved: DataFrame, captures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Saved keys that the data no longer have: with any of them the split has to be made anew."""
    return saved.join(captures.select(*keys), list(keys), "left_anti")


def event_weight(captures: DataFrame, keys: tuple[str, ...], first_files: int | None = None) -> DataFrame:
    """One row (n_distinct, weight): 1 / distinct captures, or extrapolated from the first files; 1.0 without any."""
    n_files = captures.select(F.count_distinct("file_idx").alias("n_files"))
    counted = captures if first_files is None else captures.where(F.col("file_idx") < first_files)
    n = counted.select(*keys).distinct().agg(F.count("*").alias("n_distinct"))
    both = n.join(F.broadcast(n_files))
    scale = F.lit(1.0) if first_files is None else F.greatest(F.col("n_files") / F.lit(float(first_files)), F.lit(1.0))
    return both.select("n_distinct", F.when(F.col("n_distinct") > 0, 1.0 / (F.col("n_distinct") * scale)).otherwise(1.0).alias("weight"))


def weight_of_counts(per_file: DataFrame, first_files: int | None = None) -> DataFrame:
    """`event_weight` from the distinct captures of each file (file_idx, n_distinct): counts of files add up."""
    counted = F.lit(True) if first_files is None else F.col("file_idx") < first_files
    both = per_file.agg(F.coalesce(F.sum(F.when(counted, F.col("n_distinct"))), F.lit(0)).alias("n_distinct"), F.count("*").alias("n_files"))
    scale = F.lit(1.0) if first_files is None else F.greatest(F.col("n_files") / F.lit(float(first_files)), F.lit(1.0))
    return both.select("n_distinct", F.when(F.col("n_distinct") > 0, 1.0 / (F.col("n_distinct") * scale)).otherwise(1.0).alias("weight"))
