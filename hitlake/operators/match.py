"""Matching hits to captures: deduplication, detector filter, keyed time window, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.functions.geometry import finite, mm, valid_direction
from hitlake.schema import DETECTORS, KEY, Geometry


def dedup_last_wins(captures: DataFrame, keys: tuple[str, ...] = KEY, order: str = "row_ix") -> DataFrame:
    """One row per key, that with the largest position in its file."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return captures.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def detector_filter(photons: DataFrame, detectors: tuple[int, ...] = DETECTORS) -> DataFrame:
    return photons.where(F.col("det_uid").isin(*detectors))


def valid_rows(photons: DataFrame) -> DataFrame:
    """Drop hits with a non-finite position, direction or time (counted as invalid by the summary)."""
    return photons.where(finite(*[F.col(c) for c in ("x", "y", "z", "px", "py", "pz", "time")]))


def time_window_join(photons: DataFrame, captures: DataFrame, window: float = 200.0, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hits within [capture time, capture time + window], both ends closed, capture time in single precision.

    An equi-join on the key with the range as residual: captures are one row per key, and a key with very many hits is
    split by adaptive execution.
    """
    nc = captures.select(*keys, F.col("nc_time").cast("float").alias("_t"))
    late = F.col("time") <= (F.col("_t") + F.lit(window).cast("float"))
    return photons.join(nc, list(keys)).where((F.col("time") >= F.col("_t")) & late).drop("_t")


def orphans_unmatched(photons: DataFrame, captures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hits whose key no capture has."""
    return photons.join(captures.select(*keys), list(keys), "left_anti")


def orphans_sentinel(photons: DataFrame) -> DataFrame:
    """Hits that name no capture (negative id)."""
    return photons.where("nc_id < 0")


def direction_filter(photons: DataFrame, geometry: Geometry = Geometry()) -> DataFrame:
    """Hits that cross the surface from inside; positions in metres become millimetres (single precision)."""
    scaled = photons.withColumns({c: mm(F.col(c)) for c in "xyz"})
    return scaled.where(valid_direction(*[F.col(c) for c in ("x", "y", "z", "px", "py", "pz")], geometry))


def matched_hits(photons: DataFrame, captures: DataFrame, window: float = 200.0, geometry: Geometry = Geometry()) -> DataFrame:
    """All filters in order of cost: detector, finite, key and time, direction."""
    return direction_filter(time_window_join(valid_rows(detector_filter(photons)), captures, window), geometry)
