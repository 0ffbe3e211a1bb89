"""Readers of raw inputs, dictionaries, voxels and geometry text, and the file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitlake import schema
from hitlake.operators import ranks
from hitlake.sources import inventory


def read_captures(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Capture records with the 16 gamma columns packed into one array of structs; `files`: only these of the folder.

    Files that cannot be read add nothing: `inventory.failures` tells which.
    """
    raw = inventory.raw(spark, path, schema.RAW_NC, files)
    slot = lambda i: F.struct(*[F.col(f"gamma{i}_{c}").alias(n) for c, n in (("E", "e"), ("px", "px"), ("py", "py"), ("pz", "pz"))])
    return raw.select(
        "source_file", "row_ix", "evtid", F.col("nC_track_id").alias("nc_id"), *[F.col(f"nC_{c}_position_in_m").alias(c) for c in "xyz"],
        F.col("nC_time_in_ns").alias("nc_time"), F.col("nC_gamma_amount").alias("gamma_amount"), F.col("nC_gamma_total_energy_in_keV").alias("gamma_total"),
        F.col("nC_material_id").alias("mat_local"), F.col("nC_phys_vol_id").alias("vol_local"), F.array(*[slot(i) for i in range(1, 5)]).alias("gammas"), F.col("nC_flag_Ge77").alias("flag"),
    )


def read_photons(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Detector hits; unused columns and other detectors are pruned by the scan."""
    raw = inventory.raw(spark, path, schema.RAW_OPTICAL, files)
    return raw.select(
        "source_file", "evtid", F.col("nC_track_id").alias("nc_id"), "det_uid", *[F.col(f"{c}_position_in_m").alias(c) for c in "xyz"],
        *[F.col(f"{c}_momentum_direction").alias(f"p{c}") for c in "xyz"], F.col("time_in_ns").alias("time"),
    )


def read_local_names(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Entries of the file-local dictionaries, overwritten ones too."""
    return inventory.raw(spark, path, schema.LOCAL_NAMES, files).drop("_path")


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of one JSON array, with their place in it as `ord`."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<{schema.VOXEL.simpleString()}>")
    return text.select(F.posexplode(items).alias("ord", "v")).select("ord", "v.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `sinks.write_ordered` with their place (column position, from 0): that of the file, then that in the file."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    begins = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_begin"))  # a row per file
    return rows.join(F.broadcast(begins), "_file").withColumn("position", F.col("_begin") + F.col("_row")).drop("_file", "_row", "_begin")


def read_json_report(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    return spark.read.schema(kind).json(path)


def manifest(files: DataFrame) -> DataFrame:
    """File index, file and run name from distinct paths (column source_file)."""
    parts = F.split("source_file", "/")
    named = ranks.numbered(files.select("source_file").distinct(), "source_file", "_place")
    return named.select("source_file", F.col("_place").cast("int").alias("file_rank"), F.element_at(parts, -1).alias("file_name"), F.element_at(parts, -2).alias("run"))


def discover(spark: SparkSession, base: str, nested: bool = False, pattern: str = "output_*") -> DataFrame:
    """Paths under base, flat or exactly one level down, whose name fits the pattern."""
    level = f"{base}/*" if nested else base
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(level)
    return rows.select(F.col("path").alias("source_file"))


def of_runs(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Manifest rows whose run is listed (column run); listed runs without files add nothing."""
    return files.join(runs.select("run").distinct(), "run", "left_semi")


def sample_files(files: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n files (all, if fewer), in the order of md5(seed:path): the same files on every run and engine."""
    return files.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source_file"))), "source_file").limit(n)
