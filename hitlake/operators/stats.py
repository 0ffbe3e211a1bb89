"""Photon statistics: per file, yields per capture, relative times, materials, flags, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.functions.geometry import percent
from hitlake.operators import ranks
from hitlake.schema import KEY
from hitlake.sources.scratch import materialise

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
#: Closed ranges of relative time in ns (fixed values).
RANGES = ((-50, 500), (0, 200), (-10, 10), (-50, 50), (-100, 100), (0, 100), (0, 500))


def photon_counts(photons: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hits per capture key they name (id >= 0), known to the captures or not."""
    return photons.where("nc_id >= 0").groupBy(*keys).agg(F.count("*").alias("n_photons"))


def yield_distribution(photons: DataFrame, captures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Every key of captures or hits with its number of hits: a full outer join."""
    known = captures.select(*keys).distinct()
    return known.join(photon_counts(photons, keys), list(keys), "full_outer").withColumn("n_photons", F.coalesce("n_photons", F.lit(0)))


def zero_photon_captures(photons: DataFrame, captures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return captures.select(*keys).distinct().join(photon_counts(photons, keys), list(keys), "left_anti")


def nc_photon_table(photons: DataFrame, captures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Every capture record, repeated keys too, with the hits of its key or 0."""
    joined = captures.join(photon_counts(photons, keys), list(keys), "left")
    return joined.withColumn("n_photons", F.coalesce("n_photons", F.lit(0)))


def file_stats(photons: DataFrame, captures: DataFrame) -> DataFrame:
    """Per file: hits, orphans, valid hits, captures, with and without hits, and percentages (0 for an empty whole)."""
    hits = photons.groupBy("file_idx").agg(F.count("*").alias("n_photons"), F.count(F.when(F.col("nc_id") < 0, 1)).alias("n_orphaned"))
    yields = yield_distribution(photons, captures)
    per = yields.groupBy("file_idx").agg(F.count(F.when(F.col("n_photons") > 0, 1)).alias("n_with_photons"), F.count(F.when(F.col("n_photons") == 0, 1)).alias("n_zero"))
    distinct = captures.select(*KEY).distinct().groupBy("file_idx").agg(F.count("*").alias("n_captures"))
    counts = ("n_photons", "n_orphaned", "n_with_photons", "n_zero", "n_captures")
    joined = hits.join(per, "file_idx", "full_outer").join(distinct, "file_idx", "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    joined = joined.withColumn("n_valid", F.col("n_photons") - F.col("n_orphaned"))
    return joined.withColumns({"pct_orphaned": percent(F.col("n_orphaned"), F.col("n_photons")), "pct_zero": percent(F.col("n_zero"), F.col("n_captures"))})


def yield_summary(per_file: DataFrame, yields: DataFrame) -> DataFrame:
    """One row: totals over files and the distribution of hits per capture."""
    totals = per_file.agg(*[F.sum(c).alias(c) for c in ("n_photons", "n_orphaned", "n_valid", "n_captures", "n_with_photons", "n_zero")])
    v = F.col("n_photons")
    shape = yields.agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"), F.median(F.when(v > 0, v)).alias("median_positive"), F.median(F.when(v.between(1, 100), v)).alias("median_1_100"),
    )
    out = totals.join(F.broadcast(shape))  # one row each
    return out.withColumns({"pct_orphaned": percent(F.col("n_orphaned"), F.col("n_photons")), "pct_zero": percent(F.col("n_zero"), F.col("n_captures"))})


def top_orphan_files(per_file: DataFrame, n: int = 10) -> DataFrame:
    """Files with the largest orphaned share; ties by run and file."""
    return per_file.orderBy(F.col("pct_orphaned").desc(), "file_idx").limit(n)


def relative_times(photons: DataFrame, captures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hit time minus capture time, matched hits only."""
    nc = captures.select(*keys, "nc_time")
    return photons.join(nc, list(keys)).withColumn("dt", F.col("time") - F.col("nc_time"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, deviation, ends and quartiles."""
    rows, v = materialise(df.select(value)), F.col(value)
    q25, median, q75 = ranks.quantiles(rows, value, [0.25, 0.5, 0.75])
    shape = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return shape.withColumns({name: F.lit(x).cast("double") for name, x in (("median", median), ("q25", q25), ("q75", q75))})


def percentiles(df: DataFrame, value: str, at: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(percentile, value), exact with linear interpolation."""
    found = ranks.quantiles(materialise(df.select(value)), value, [p / 100 for p in at])
    return df.sparkSession.createDataFrame(list(zip(at, found)), "percentile int, value double")


def window_counts(df: DataFrame, value: str, ranges: tuple = RANGES) -> DataFrame:
    """(lo, hi, n, pct): rows in each closed range, one pass."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count(F.when(F.col(value).between(lo, hi), 1)).alias(f"_n{i}") for i, (lo, hi) in enumerate(ranges)])
    rows = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"_n{i}").alias("n")) for i, (lo, hi) in enumerate(ranges)])
    return counts.select(F.explode(rows).alias("r"), "_all").select("r.*", percent(F.col("r.n"), F.col("_all")).alias("pct"))


def material_yield(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Captures, hits and hits per capture by material; ids without a name are Unknown_<id>; rank 1 has the largest yield."""
    sums = table.groupBy(F.col("mat_id").alias("id")).agg(F.count("*").alias("n_captures"), F.sum("n_photons").alias("n_photons"))
    named = sums.join(dictionary.select("id", "name"), "id", "left")
    named = named.select(F.coalesce("name", F.concat(F.lit("Unknown_"), F.col("id").cast("string"))).alias("material"), "n_captures", "n_photons", (F.col("n_photons") / F.col("n_captures")).alias("photons_per_capture"))
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.col("photons_per_capture").desc(), "material"))).orderBy("rank")  # a row per material


def flag_comparison(table: DataFrame) -> DataFrame:
    """One row: share of flagged captures, mean and median hits of both kinds, ratio of the means (null without one)."""
    on, off = F.when(F.col("flag"), F.col("n_photons")), F.when(~F.col("flag"), F.col("n_photons"))
    row = table.agg(F.count(on).alias("n_flagged"), F.count("*").alias("n_all"), F.avg(on).alias("mean_flagged"), F.avg(off).alias("mean_other"), F.median(on).alias("median_flagged"), F.median(off).alias("median_other"))
    return row.withColumns({"pct_flagged": percent(F.col("n_flagged"), F.col("n_all")), "mean_ratio": F.try_divide("mean_flagged", "mean_other")})


def range_summary(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: minimum, maximum and median of each column, of a table that is written once."""
    rows = materialise(table.select(*columns))
    medians = ranks.quantiles_of(rows, {c: [0.5] for c in columns})
    ends = rows.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    return ends.withColumns({f"{c}_median": F.lit(medians[c][0]).cast("double") for c in columns})
