"""Global name dictionaries: collect, extend, remap, invert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitised(name: Column, empty: str = "noVolume") -> Column:
    return F.when(name == "", F.lit(empty)).otherwise(name)


def collect_names(local: DataFrame, empty: str | None = "noVolume") -> DataFrame:
    """Distinct names of all files (column name)."""
    name = sanitised(F.col("name"), empty) if empty else F.col("name")
    return local.select(name.alias("name")).distinct()


def extend(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, id): existing ids stay; new names get the next ids in ascending order.

    The window sees only the names of the dictionary, which a detector description bounds.
    """
    if existing is None:
        return names.select("name", F.row_number().over(Window.orderBy("name")).alias("id"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = names.join(existing, "name", "left_anti").select("name", F.row_number().over(Window.orderBy("name")).alias("_rank"))
    return existing.select("name", "id").unionByName(new.join(F.broadcast(top)).select("name", (F.col("_rank") + F.col("_top")).cast("int").alias("id")))


def inverted(dictionary: DataFrame) -> DataFrame:
    """(id, name); of several names of one id the last in name order."""
    return dictionary.groupBy("id").agg(F.max("name").alias("name"))


def last_of_file(local: DataFrame, order: str = "row_ix") -> DataFrame:
    """Of repeated local ids in a file the later row counts."""
    return local.groupBy("file_idx", "local_id").agg(F.max_by("name", order).alias("name"))


def remap(rows: DataFrame, local: DataFrame, dictionary: DataFrame, column: str, out: str, empty: str | None = None) -> DataFrame:
    """Add the global id for a file-local id, through the name; null where either step has no entry (see `quarantine`)."""
    name = sanitised(F.col("name"), empty) if empty else F.col("name")
    local = local.select("file_idx", F.col("local_id").alias(column), name.alias("name"))
    ids = local.join(dictionary.select("name", F.col("id").alias(out)), "name", "left").drop("name")
    return rows.join(ids, ["file_idx", column], "left")


def quarantine(remapped: DataFrame, columns: tuple[str, ...], by: str = "file_idx") -> DataFrame:
    """Files with an id that could not be mapped: (file, reason, rows)."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    bad = remapped.withColumn("_missing", missing).where("_missing <> ''")
    return bad.groupBy(by).agg(F.concat(F.lit("unmapped "), F.concat_ws(",", F.array_sort(F.collect_set("_missing")))).alias("reason"), F.count("*").alias("n_rows"))
