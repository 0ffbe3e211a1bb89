"""Build the training set: the full DAG over all files, its sinks, and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.operators import match, nearest, split, targets
from hitlake.schema import KEY, LAYERS, Geometry


def capture_targets(photons: DataFrame, captures: DataFrame, voxels: DataFrame, window: float, geometry: Geometry = Geometry(), search: nearest.Search | None = None) -> DataFrame:
    """Per capture: total hits, hits by region, and hits by voxel (`voxel_hits`, a map of the voxels that were hit, and
    their number `voxels_hit`); captures without hits included.
    """
    nc = match.dedup_last_wins(captures)
    hits = match.matched_hits(photons, nc, window, geometry)
    by_voxel = targets.voxel_hits(nearest.nearest_grid(nearest.spread(hits), voxels if search is None else search))
    return targets.with_targets(nc, targets.region_hits(by_voxel, voxels))


def training_set(photons: DataFrame, captures: DataFrame, voxels: DataFrame, splits: DataFrame, window: float = 200.0, split_keys: tuple[str, ...] = ("file_idx", "evtid"), scale: float = 1000.0, geometry: Geometry = Geometry(), sample_files: int | None = None, weight: DataFrame | None = None, search: nearest.Search | None = None) -> DataFrame:
    """Key, split, 30 features, 4 region counts, the counts by voxel and the weight; `captures` carry global mat_id and vol_id.

    `weight` is one row with a column of that name; without it the captures' keys are counted (of the first `sample_files`).
    `search`, if it is given, is `nearest.prepared` of the voxels.
    """
    rows = capture_targets(photons, captures, voxels, window, geometry, search)
    counts = ("total_hits", *LAYERS, "voxels_hit", "voxel_hits")
    phi = targets.features(rows, scale, geometry, kept=counts)  # not joined to them: the search would run for both sides
    weight = (split.event_weight(captures, KEY, sample_files) if weight is None else weight).select(F.col("weight").cast("float").alias("weight"))
    joined = split.reuse_split(phi, splits, split_keys)
    return joined.join(F.broadcast(weight))  # one row


def write_training_set(rows: DataFrame, path: str, fresh: bool = False) -> None:
    """Idempotent: only the partitions of the files that are in `rows` are replaced; with `fresh`, all there is.

    The rows of a partition meet before they are written: one file each, not one from every task that holds some of them.
    The files are what takes time, however few bytes there are, so they are dealt over a fixed number of tasks.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "split", "file_idx").write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic").partitionBy("split", "file_idx").parquet(path)


def geometry_table(spark: SparkSession, geometry: Geometry, primaries: int) -> DataFrame:
    """(name, value) of the static geometry: radius, cuts, height, lift, and the number of primaries."""
    values = {"radius": geometry.radius, "height": geometry.height, "cut_bottom": geometry.cut_bottom, "cut_top": geometry.cut_top, "lift": geometry.lift, "primaries": float(primaries)}
    listed = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in values.items()])
    return spark.range(1, numPartitions=1).select(F.inline(listed))


def write_dimensions(path: str, fresh: bool = False, **tables: DataFrame) -> None:
    """Dimension tables, written once; existing ones stay unless `fresh`."""
    for name, df in tables.items():
        df.write.mode("overwrite" if fresh else "ignore").parquet(f"{path}/{name}")
