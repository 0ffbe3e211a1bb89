"""The registered queries: each applies library operators to views over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.functions import bins
from hitlake.functions import geometry as geo
from hitlake.operators import dictionary, groups, match, nearest, reconcile, split, stats, targets
from hitlake.plans import api, build
from hitlake.plans.oracle import ORACLE_SQL  # noqa: F401  re-exported for the driver's entry
from hitlake.schema import KEY, LAYERS, PHI
from hitlake.sources import bucketed, inventory, names, readers, sinks, views
from hitlake.sources.scratch import materialise, scratch, together
from hitlake.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: With a wide window more captures get hits in the driver's tables.
WIDE = 1500.0


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles that both engines print alike; adding 0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.dedup_last_wins(views.captures(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str, window: float = WIDE) -> DataFrame:
    return match.matched_hits(views.photons(spark, sf_dir), _deduped(spark, sf_dir), window)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_grid(nearest.spread(_hits(spark, sf_dir)), views.voxels(spark, sf_dir))


def _dictionary(spark: SparkSession, sf_dir: str, column: str, empty: str | None = None) -> DataFrame:
    return dictionary.extend(dictionary.collect_names(views.local_dictionary(spark, sf_dir, column), empty))


def _global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with global material and volume ids, mapped from the file-local ones."""
    nc = views.with_local_ids(spark, sf_dir)
    for column, local, out, empty in (("material", "mat_local", "mat_id", None), ("volume", "vol_local", "vol_id", "noVolume")):
        nc = dictionary.remap(nc, views.local_dictionary(spark, sf_dir, column), _dictionary(spark, sf_dir, column, empty), local, out, empty)
    return nc


# ---------------------------------------------------------------- scans and filters


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid hits per capture and region, with cylindrical coordinates."""
    rows = build.capture_targets(views.photons(spark, sf_dir), views.captures(spark, sf_dir), views.voxels(spark, sf_dir), WIDE)
    x, y = geo.mm(F.col("x")), geo.mm(F.col("y"))
    out = rows.select(*KEY, "total_hits", *LAYERS, geo.radius(x, y).alias("r_mm"), geo.azimuth(x, y).alias("phi_rad"))
    return rounded(out, "r_mm", "phi_rad")


@query
def raw_nc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nc = views.captures(spark, sf_dir)
    return rounded(nc.select(*KEY, "row_ix", "nc_time", *[geo.mm(F.col(c)).alias(f"{c}_mm") for c in "xyz"], F.col("gammas")[0]["e"].alias("e1"), "flag"), "x_mm", "y_mm", "z_mm")


@query
def raw_optical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.photons(spark, sf_dir).select("photon_id", *KEY, "det_uid", *[geo.mm(F.col(c)).alias(f"{c}_mm") for c in "xyz"], "px", "py", "pz", "time"), "x_mm", "y_mm", "z_mm", "px", "py", "pz")


@query
def detector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.detector_filter(views.photons(spark, sf_dir)).select("photon_id", "det_uid")


@query
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select(*KEY, "row_ix", "nc_time")


@query
def time_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.time_window_join(match.detector_filter(views.photons(spark, sf_dir)), _deduped(spark, sf_dir)).select("photon_id", *KEY, "time")


@query
def orphan_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.orphans_unmatched(match.detector_filter(views.photons(spark, sf_dir)), _deduped(spark, sf_dir))
    return found.groupBy("file_idx").agg(F.count("*").alias("n_orphans"))


@query
def orphan_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.orphans_sentinel(views.photons(spark, sf_dir)).groupBy("file_idx").agg(F.count("*").alias("n_orphans"))


@query
def direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.direction_filter(match.valid_rows(match.detector_filter(views.photons(spark, sf_dir))))
    return rows.select("photon_id", geo.region(F.col("z")).alias("region"))


# ---------------------------------------------------------------- voxels and targets


@query
def nearest_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_grid(_hits(spark, sf_dir, 200.0), views.voxels(spark, sf_dir)).select("photon_id", "voxel_index")


@query
def nearest_voxel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_grid(_hits(spark, sf_dir, 200.0), views.voxels(spark, sf_dir), cell=1000.0).select("photon_id", "voxel_index")


@query
def voxel_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.voxel_hits(_assigned(spark, sf_dir))


@query
def region_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.region_hits(targets.voxel_hits(_assigned(spark, sf_dir)), views.voxels(spark, sf_dir)).drop("voxel_hits")


@query
def dense_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = targets.dense_target(targets.voxel_hits(_assigned(spark, sf_dir)), views.voxels(spark, sf_dir), listed=True)
    text = F.array_join(F.transform("hit", lambda p: F.concat_ws(":", p["at"].cast("string"), p["hits"].cast("string"))), ",")
    total = F.aggregate("hit", F.lit(0).cast("bigint"), lambda a, p: a + p["hits"])
    return full.select(*KEY, "n_voxels", total.alias("total"), text.alias("nonzero"))


@query
def voxel_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.voxel_metadata(views.voxels(spark, sf_dir)), "r", "phi", "z", *[f"is_{n}" for n in LAYERS])


@query
def dimension_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static dimensions of a training set as (dimension, key, value) rows."""
    rows = [_dictionary(spark, sf_dir, c, e).select(F.lit(c).alias("dimension"), F.col("name").alias("key"), F.col("id").cast("double").alias("value")) for c, e in (("material", None), ("volume", "noVolume"))]
    rows.append(views.voxels(spark, sf_dir).select(F.posexplode("center").alias("i", "value"), "index").select(F.concat(F.lit("center_"), F.col("i").cast("string")).alias("dimension"), F.col("index").alias("key"), "value"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---------------------------------------------------------------- features


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.features(match.dedup_last_wins(_global_ids(spark, sf_dir)))


@query
def nc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {c: c.replace("#gamma", "n_gamma") for c in PHI[:14]}
    rows = _features(spark, sf_dir).select(*KEY, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    coarse = [n for n in names.values() if n.endswith(("_mm", "_keV"))]
    return rounded(rounded(rows, *[n for n in names.values() if n not in coarse]), *coarse, digits=3)


@query
def gamma_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select(*KEY, *PHI[14:]), *PHI[14:])


@query
def gamma_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = geo.gamma_slots(F.col("gammas"))
    return rounded(_deduped(spark, sf_dir).select(*KEY, geo.mean_direction(slots, "r").alias("p_mean_r"), geo.mean_direction(slots, "z").alias("p_mean_z")), "p_mean_r", "p_mean_z")


# ---------------------------------------------------------------- dictionaries


@query
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume dictionary of the first files, extended by the names of all."""
    local = views.local_dictionary(spark, sf_dir, "volume")
    first = dictionary.extend(dictionary.collect_names(local.where("file_idx = 0")))
    return dictionary.extend(dictionary.collect_names(local), first)


@query
def dictionary_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _global_ids(spark, sf_dir).groupBy("file_idx", "mat_local", "mat_id", "vol_local", "vol_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- split, weights, training set


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(views.captures(spark, sf_dir))


@query
def split_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split saved when every seventh file was not there yet: its captures train."""
    nc = _deduped(spark, sf_dir)
    saved = split.group_split(nc.where("file_idx % 7 <> 0"))
    return split.reuse_split(nc, saved, ("file_idx", "evtid")).groupBy("file_idx", "split").agg(F.count("*").alias("n"))


@query
def event_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.event_weight(views.captures(spark, sf_dir), KEY).withColumn("weight", F.round("weight", 12))


@query
def event_weight_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.event_weight(views.captures(spark, sf_dir), KEY, first_files=5).withColumn("weight", F.round("weight", 12))


def _training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    nc = _global_ids(spark, sf_dir)
    return build.training_set(views.photons(spark, sf_dir), nc, views.voxels(spark, sf_dir), split.group_split(nc), WIDE)


@query
def build_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training_set(spark, sf_dir).select(*KEY, "split", "total_hits", *LAYERS, "voxels_hit", F.col("matID").cast("int").alias("mat_id"), F.col("volID").cast("int").alias("vol_id"), "r_NC_mm", "weight")
    return rows.withColumns({"r_NC_mm": F.round(F.col("r_NC_mm").cast("double"), 3), "weight": F.round(F.col("weight").cast("double"), 9)})


@query
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.completeness(_deduped(spark, sf_dir), _training_set(spark, sf_dir))


@query
def distinct_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.distinct_captures(views.captures(spark, sf_dir))


@query
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input captures against the rows of a build that lost every 29th file."""
    nc = views.captures(spark, sf_dir)
    rows = split.reuse_split(_deduped(spark, sf_dir).where("file_idx % 29 <> 1"), split.group_split(nc), ("file_idx", "evtid"))
    return rounded(reconcile.reconcile(nc, rows), "pct_recovered", "pct_lost", "pct_train", "pct_validation")


@query
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: captures with and without valid hits, rows of both splits, hits without a capture."""
    nc = _deduped(spark, sf_dir)
    rows = targets.with_targets(nc, targets.region_hits(targets.voxel_hits(_assigned(spark, sf_dir)), views.voxels(spark, sf_dir)))
    rows = split.reuse_split(rows, split.group_split(nc), ("file_idx", "evtid"))
    count = lambda c: F.count(F.when(c, 1))
    per = rows.groupBy("file_idx").agg(count(F.col("total_hits") > 0).alias("n_with"), count(F.col("total_hits") == 0).alias("n_without"), count(F.col("split") == "train").alias("n_train"), count(F.col("split") == "validation").alias("n_validation"))
    lost = orphan_unmatched(spark, sf_dir)
    return per.join(lost, "file_idx", "left").withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0)))


# ---------------------------------------------------------------- files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = views.captures(spark, sf_dir).select("file_idx").distinct().withColumn("source_file", F.expr(views.source_file("file_idx")))
    return paths.join(readers.manifest(paths), "source_file")


@query
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the runs 001 to 008, with their place in path order."""
    runs = _files(spark, sf_dir).select("run").where("run <= 'run008'")
    return readers.of_runs(_files(spark, sf_dir), runs).select("source_file", "file_idx", "file_rank", "file_name", "run")


@query
def file_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sample_files(_files(spark, sf_dir).select("source_file"), 10)


@query
def remaining_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("source_file", "file_idx")
    return incremental.remaining_files(files, files.where("file_idx % 3 = 0"))


@query
def file_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose local dictionary lost an entry: every fifth file lacks one material, every sixth one volume."""
    nc = views.with_local_ids(spark, sf_dir)
    for column, local, out, empty, gone in (("material", "mat_local", "mat_id", None, "file_idx % 5 = 0 and local_id = 3"), ("volume", "vol_local", "vol_id", "noVolume", "file_idx % 6 = 0 and local_id = 4")):
        nc = dictionary.remap(nc, views.local_dictionary(spark, sf_dir, column).where(f"not ({gone})"), _dictionary(spark, sf_dir, column, empty), local, out, empty)
    return dictionary.quarantine(nc, ("mat_id", "vol_id"))


# ---------------------------------------------------------------- statistics


def _yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.yield_distribution(views.photons(spark, sf_dir), views.captures(spark, sf_dir))


def _file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_stats(views.photons(spark, sf_dir), views.captures(spark, sf_dir))


def _photon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stats.nc_photon_table(match.detector_filter(views.photons(spark, sf_dir)), _global_ids(spark, sf_dir))
    x, y, z = (geo.mm(F.col(c)) for c in "xyz")
    return table.withColumns({"r": geo.radius(x, y), "z_mm": z.cast("double"), "gamma1": F.col("gammas")[0]["e"], "total": F.col("gamma_total")})


def _dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.relative_times(match.detector_filter(views.photons(spark, sf_dir)), _deduped(spark, sf_dir))


@query
def file_photon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_file_stats(spark, sf_dir), "pct_orphaned", "pct_zero")


@query
def photon_yield_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.yield_summary(_file_stats(spark, sf_dir), _yields(spark, sf_dir))
    return rounded(out, "mean", "median", "std", "q25", "q75", "median_positive", "median_1_100", "pct_orphaned", "pct_zero")


@query
def top_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.top_orphan_files(_file_stats(spark, sf_dir)).select("file_idx", "n_photons", "n_orphaned", "pct_orphaned"), "pct_orphaned")


@query
def photon_yield_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yields(spark, sf_dir)


@query
def zero_photon_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zero_photon_captures(views.photons(spark, sf_dir), views.captures(spark, sf_dir))


@query
def nc_photon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_photon_table(spark, sf_dir).select(*KEY, "row_ix", "n_photons", "r", "z_mm", "gamma1", "total", "mat_id", "flag"), "r", "z_mm", "gamma1", "total")


@query
def dt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.distribution(_dt(spark, sf_dir), "dt"), "mean", "median", "std", "min", "max", "q25", "q75")


@query
def dt_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.percentiles(_dt(spark, sf_dir), "dt"), "value")


@query
def dt_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.window_counts(_dt(spark, sf_dir), "dt"), "pct")


@query
def material_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a dictionary that lacks one material: its captures show as Unknown_<id>."""
    names = _dictionary(spark, sf_dir, "material").where("name <> '5-LOW'")
    return rounded(stats.material_yield(_photon_table(spark, sf_dir), names), "photons_per_capture")


@query
def flag_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.flag_comparison(_photon_table(spark, sf_dir)), "mean_flagged", "mean_other", "median_flagged", "median_other", "pct_flagged", "mean_ratio")


@query
def nc_range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("r", "z_mm", "gamma1", "total")
    return rounded(stats.range_summary(_photon_table(spark, sf_dir), columns), *[f"{c}_{n}" for c in columns for n in ("min", "max", "median")])


# ---------------------------------------------------------------- histograms


def _values(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The column alone, written once: the edges need its ends first, then the bins need it again."""
    return materialise(rows.select(*by, F.col(value).cast("double").alias(value)))


@query
def group_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per capture by volume name: 50 bins from 0 to the largest, also per event of the group."""
    counts = _values(_photon_table(spark, sf_dir), "n_photons", ("volume",))
    table = bins.histogram(counts, "n_photons", bins.linear(0.0, max(bins.largest(counts, "n_photons"), 1.0), 50), ("volume",))
    events = counts.groupBy("volume").agg(F.count("*").alias("_events"))
    return rounded(table.join(events, "volume").withColumn("per_event", F.col("n") / F.col("_events")).drop("_events"), "lo", "hi", "per_event")


@query
def hist_log_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _values(_yields(spark, sf_dir), "n_photons")
    return rounded(bins.histogram(counts, "n_photons", bins.zero_and_log(bins.largest(counts, "n_photons"))), "lo", "hi")


@query
def hist_small_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bins.histogram(_yields(spark, sf_dir).where("n_photons <= 100"), "n_photons", bins.small_counts()), "lo", "hi")


@query
def hist_file_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned and zero-photon percentages per file, 30 bins each from smallest to largest."""
    rows, out = materialise(rounded(_file_stats(spark, sf_dir), "pct_orphaned", "pct_zero")), None
    for c in ("pct_orphaned", "pct_zero"):
        lo, hi = bins.smallest(rows, c), bins.largest(rows, c)
        one = bins.histogram(rows, c, bins.linear(lo, hi if hi > lo else lo + 1, 30)).withColumn("metric", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "lo", "hi")


@query
def hist_dt_symlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _values(_dt(spark, sf_dir), "dt")
    return rounded(bins.histogram(counts, "dt", bins.symmetric_log(bins.smallest(counts, "dt"), bins.largest(counts, "dt"))), "lo", "hi")


@query
def hist_dt_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _dt(spark, sf_dir).where("dt between -50 and 500")
    return rounded(bins.histogram(counts, "dt", bins.linear(-50.0, 500.0, 99)), "lo", "hi")


@query
def hist_flag_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _values(_photon_table(spark, sf_dir), "n_photons", ("flag",))
    edges = bins.log_space(0.0, max(bins.largest(counts, "n_photons"), 1.000001), 50)
    return rounded(bins.histogram(counts, "n_photons", edges, ("flag",)), "lo", "hi")


@query
def hist2d_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.histogram_2d(_photon_table(spark, sf_dir), "r", "z_mm", bins.linear(0.0, 6000.0, 99), bins.linear(-5000.0, 4000.0, 99))


@query
def hist2d_energy_photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total gamma energy above 0 against hits up to their 99th percentile."""
    rows = materialise(_photon_table(spark, sf_dir).where("total > 0").select("total", "n_photons"))
    top = rows.agg(F.percentile(F.col("n_photons"), F.lit(0.99)), F.max("total")).first()
    return bins.histogram_2d(rows, "total", "n_photons", bins.linear(0.0, float(top[1] or 1.0), 59), bins.linear(0.0, max(float(top[0] or 0.0), 1.0), 59))


# ---------------------------------------------------------------- groups and names


@query
def regex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.grouped_names(views.captures(spark, sf_dir), "phys_volume")


@query
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.unmatched_names(groups.grouped_names(views.captures(spark, sf_dir), "phys_volume"))


def _event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _deduped(spark, sf_dir).select(*KEY, F.col("phys_volume").alias("name"))
    return groups.event_totals(events, targets.voxel_hits(_assigned(spark, sf_dir)), KEY)


@query
def event_hit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_totals(spark, sf_dir).drop("name")


@query
def group_spectrum_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = groups.grouped_names(views.captures(spark, sf_dir), "phys_volume")
    return rounded(groups.spectrum_stats(_event_totals(spark, sf_dir), grouped), "mean_hits", "mean_voxels", "median_hits", "median_voxels")


@query
def extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of the raw pages, one line at a time, with their lengths."""
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.split("html", "\n")).alias("value"))
    return groups.extract_names(lines, r'<a[^>]* href="([^"]+)"').withColumn("n_chars", F.length("name"))


@query
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written as a folder of files, built file by file by a stream, read back: rows per split."""
    base = f"{scratch(spark)}/incremental-{uuid.uuid4().hex}"
    nc = views.captures(spark, sf_dir).select(*KEY, "row_ix", "nc_time")
    nc.repartition(8, "file_idx").write.parquet(f"{base}/in")
    frozen = split.group_split(nc)

    def make(batch: DataFrame) -> DataFrame:
        return split.reuse_split(match.dedup_last_wins(batch), frozen, ("file_idx", "evtid"))

    incremental.incremental_build(spark, f"{base}/in", nc.schema, f"{base}/state", f"{base}/out", make, files_per_batch=3)
    return spark.read.parquet(f"{base}/out").groupBy("split").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- whole jobs over raw files

_raw: dict[tuple[str, str], api.Inputs] = {}
_written: dict[tuple[str, str], tuple[api.Inputs, str]] = {}


def _raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views in the form of raw records and local dictionaries with overwritten entries, by kind of file."""
    path = F.expr(views.source_file("file_idx")).alias("source_file")
    local = dict(zip(("material", "volume"), together(spark, *[lambda c=c: materialise(views.local_dictionary(spark, sf_dir, c)) for c in ("material", "volume")])))  # read for both kinds of files
    nc = views.with_local_ids(spark, sf_dir, local)
    gammas = [F.col("gammas")[i - 1][n].alias(f"gamma{i}_{c}") for i in range(1, 5) for c, n in (("E", "e"), ("px", "px"), ("py", "py"), ("pz", "pz"))]
    captures = nc.select(
        path, F.col("row_ix").cast("bigint").alias("row_ix"), "evtid", F.col("nc_id").alias("nC_track_id"), *[F.col(c).alias(f"nC_{c}_position_in_m") for c in "xyz"], F.col("nc_time").alias("nC_time_in_ns"),
        F.col("gamma_amount").alias("nC_gamma_amount"), F.col("gamma_total").alias("nC_gamma_total_energy_in_keV"), F.col("mat_local").cast("int").alias("nC_material_id"), F.col("vol_local").cast("int").alias("nC_phys_vol_id"), *gammas, F.col("flag").alias("nC_flag_Ge77"), "file_idx",
    )
    photons = views.photons(spark, sf_dir).select(
        path, "evtid", F.col("nc_id").alias("nC_track_id"), F.col("det_uid").cast("int").alias("det_uid"), *[F.col(c).alias(f"{c}_position_in_m") for c in "xyz"], *[F.col(f"p{c}").alias(f"{c}_momentum_direction") for c in "xyz"],
        F.lit(0.0).alias("photon_gamma_kinetic_energy_in_keV"), F.col("time").alias("time_in_ns"), "file_idx",
    )
    found = {"captures": captures, "photons": photons}
    for column, out in (("material", "materials"), ("volume", "volumes")):
        names = local[column].select(path, F.col("local_id").cast("int").alias("local_id"), "name", "file_idx")
        old = names.select("source_file", F.lit(0).cast("bigint").alias("row_ix"), "local_id", F.lit("overwritten").alias("name"), "file_idx")
        found[out] = old.unionByName(names.select("source_file", F.lit(1).cast("bigint").alias("row_ix"), "local_id", "name", "file_idx"))
    return found


def _voxel_file(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The voxels as one JSON array."""
    corner = lambda d: F.transform("center", lambda c: c + d)
    voxel = F.struct("ord", F.struct("index", "center", F.array(corner(-1.0), corner(1.0)).alias("corners"), "layer").alias("v"))
    listed = views.voxels(spark, sf_dir).agg(F.to_json(F.transform(F.sort_array(F.collect_list(voxel)), lambda x: x["v"])).alias("value"))  # a detector description
    listed.coalesce(1).write.text(path)
    return path


def _raw_files(spark: SparkSession, sf_dir: str, base: str) -> api.Inputs:
    """Several logical files to a physical one, each whole in one of them; the tables themselves may be one row group, one task."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writes = [lambda kind=kind, rows=rows: rows.repartition(tasks, "file_idx").drop("file_idx").write.parquet(f"{base}/{kind}") for kind, rows in _raw_tables(spark, sf_dir).items()]
    together(spark, *writes, lambda: _voxel_file(spark, sf_dir, f"{base}/voxels"))
    spark.range(1, numPartitions=1).select(F.lit("this is no record").alias("value")).write.text(f"{base}/captures/damaged")  # one file that cannot be read
    return api.Inputs(f"{base}/captures", f"{base}/photons", f"{base}/materials", f"{base}/volumes", f"{base}/voxels")


BUNDLES = 8


def _bundled(spark: SparkSession, sf_dir: str, base: str, only: str = "true", kinds: tuple[str, ...] = ("captures", "photons", "materials", "volumes")) -> api.Inputs:
    """Raw files of several logical files each, in one folder per bundle (file number mod 8), with small row groups."""

    def write(kind: str, rows: DataFrame) -> None:
        part = rows.where(only).withColumn("run", F.col("file_idx") % BUNDLES)
        part.repartitionById(BUNDLES, "run").sortWithinPartitions("run", "file_idx").drop("file_idx").write.mode("append").option("parquet.block.size", 1 << 16).partitionBy("run").parquet(f"{base}/{kind}")

    together(spark, *[lambda kind=kind, rows=rows: write(kind, rows) for kind, rows in _raw_tables(spark, sf_dir).items() if kind in kinds])
    return api.Inputs(f"{base}/captures", f"{base}/photons", f"{base}/materials", f"{base}/volumes", f"{base}/voxels")


def _damage(spark: SparkSession, folder: str, last_rows_only: bool) -> None:
    """Overwrite a folder's one file: without its second half, or with noise in its last row group."""
    import io

    import pyarrow.parquet as pq

    row = spark.read.format("binaryFile").load(folder).where("path like '%.parquet'").first()
    content = bytearray(row["content"])
    if last_rows_only:
        meta = pq.read_metadata(io.BytesIO(content))
        column = meta.row_group(meta.num_row_groups - 1).column(meta.num_columns // 2)
        at = column.dictionary_page_offset or column.data_page_offset
        content[at : at + 24] = bytes(b ^ 0xFF for b in content[at : at + 24])
    else:
        content = content[: len(content) // 2]
    path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytes(content))
    out.close()


def _inputs(spark: SparkSession, sf_dir: str) -> api.Inputs:
    """Raw files written once a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _raw:
        _raw[key] = _raw_files(spark, sf_dir, f"{scratch(spark)}/raw-{uuid.uuid4().hex}")
    return _raw[key]


def _build(spark: SparkSession, sf_dir: str) -> tuple[api.Inputs, str]:
    """These files built once a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        base = f"{scratch(spark)}/job-{uuid.uuid4().hex}"
        inputs = _inputs(spark, sf_dir)
        api.build_training_set(spark, inputs, f"{base}/out", window=WIDE, sample_files=None, primaries=1000)
        _written[key] = inputs, f"{base}/out"
    return _written[key]


def _row_summary(rows: DataFrame) -> DataFrame:
    hits = F.aggregate(F.map_values("voxel_hits"), F.lit(0), lambda a, n: a + n)
    return rows.select(*KEY, "split", "total_hits", *LAYERS, "voxels_hit", hits.alias("map_hits"), F.col("matID").cast("int").alias("mat_id"), F.col("volID").cast("int").alias("vol_id"), F.round(F.col("weight").cast("double"), 9).alias("weight"))


@query
def written_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files through the whole job, the written rows read back; files are ranked by path."""
    return _row_summary(spark.read.parquet(f"{_build(spark, sf_dir)[1]}/rows"))


@query
def written_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense targets of the written training set: length, sum and the voxel with most hits, first of equals."""
    inputs, out = _build(spark, sf_dir)
    hit = api.dense_targets(spark, out, inputs.voxels, listed=True)
    most = F.array_max(F.transform("hit", lambda p: F.struct(p["hits"].alias("hits"), (-p["at"]).alias("at"))))
    return hit.select(*KEY, "n_voxels", F.aggregate("hit", F.lit(0), lambda a, p: a + p["hits"]).alias("total"), F.coalesce(-most["at"], F.lit(0)).alias("most_hit"))


@query
def full_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense targets of all captures, also of those without hits: length, sum, voxels hit, and the first and last of these."""
    inputs, out = _build(spark, sf_dir)
    hit = api.dense_targets(spark, out, inputs.voxels, all_captures=True, listed=True)
    total = F.aggregate("hit", F.lit(0), lambda a, p: a + p["hits"])
    place = lambda i: F.coalesce(F.try_element_at("hit", F.lit(i))["at"], F.lit(-1))
    return hit.select(*KEY, "n_voxels", total.alias("total"), F.size("hit").alias("n_hit"), place(1).alias("first_hit"), place(-1).alias("last_hit"))


@query
def written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, out = _build(spark, sf_dir)
    return rounded(api.reconcile_counts(spark, inputs, out), "pct_recovered", "pct_lost", "pct_train", "pct_validation")


@query
def written_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.group_spectra(spark, _build(spark, sf_dir)[1]), "mean_hits", "mean_voxels", "median_hits", "median_voxels")


@query
def written_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static dimensions as (dimension, key, value) rows: geometry, dictionaries, and the voxels' lower x corner."""
    out = _build(spark, sf_dir)[1]
    read = lambda name, key, value: spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("dimension"), F.col(key).alias("key"), F.expr(value).cast("double").alias("value"))
    parts = [read("geometry", "name", "value"), read("material_map", "name", "id"), read("volume_map", "name", "id"), read("voxel_metadata", "voxel_index", "array_min(corner_x)")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every file after the job; the damaged one is there under a name of its own and shows as one row."""
    rows = api.run_record(spark, _build(spark, sf_dir)[1])
    return rows.withColumn("source_file", F.when(F.col("reason") == "unreadable", "damaged").otherwise(F.col("source_file")))


@query
def reset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once with other parameters, then started over: nothing of the first run is left."""
    inputs = _inputs(spark, sf_dir)
    out = f"{scratch(spark)}/reset-{uuid.uuid4().hex}"
    api.build_training_set(spark, inputs, out, window=200.0, val_fraction=0.5, seed=1, sample_files=None)
    api.build_training_set(spark, inputs, out, window=WIDE, sample_files=None, reset=True)
    return spark.read.parquet(f"{out}/rows").groupBy("split").agg(F.count("*").alias("n"), F.sum("total_hits").alias("hits"))


@query
def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of hits (1) and of materials (2) cut in half, one of captures (3) broken in its last row group: the record
    of all logical files, the kind of file to blame, and the rows and hits that the training set has of each."""
    base = f"{scratch(spark)}/damaged-{uuid.uuid4().hex}"
    inputs = _bundled(spark, sf_dir, f"{base}/raw")
    _voxel_file(spark, sf_dir, inputs.voxels)
    for kind, bundle in (("photons", 1), ("materials", 2), ("captures", 3)):
        if not views.captures(spark, sf_dir).where(F.col("file_idx") % BUNDLES == bundle).isEmpty():
            _damage(spark, f"{base}/raw/{kind}/run={bundle}", last_rows_only=kind == "captures")
    api.build_training_set(spark, inputs, f"{base}/out", window=WIDE, sample_files=None)
    rows = api.training_rows(spark, f"{base}/out").groupBy("source_file").agg(F.count("*").alias("n_rows"), F.sum("total_hits").alias("n_hits"))
    record = api.run_record(spark, f"{base}/out").where("source_file like 'data/%'")
    blamed = F.when(F.col("status") == "failed", F.coalesce(F.nullif(F.regexp_extract("reason", " (.*)", 1), F.lit("")), F.lit("captures")))
    out = record.withColumn("blamed", F.coalesce(blamed, F.lit(""))).join(rows, "source_file", "left")
    return out.select("source_file", "status", "blamed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_train", "rows_validation", "n_rows", "n_hits")])


@query
def resumed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built 20 files at a time, broken off after the first batch, then taken up again: the rows of one whole build."""
    inputs = _inputs(spark, sf_dir)
    out = f"{scratch(spark)}/resumed-{uuid.uuid4().hex}"
    for most in (1, None):
        api.build_training_set(spark, inputs, out, window=WIDE, sample_files=None, files_per_batch=20, most_batches=most)
    return _row_summary(api.training_rows(spark, out))


@query
def grown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files first, then all: only the new ones are counted, and the totals are those of one full count."""
    base = f"{scratch(spark)}/grown-{uuid.uuid4().hex}"
    inputs = _bundled(spark, sf_dir, f"{base}/raw", f"file_idx % {BUNDLES} < 4")
    _voxel_file(spark, sf_dir, inputs.voxels)
    api.build_training_set(spark, inputs, f"{base}/out", window=WIDE, sample_files=None)
    _bundled(spark, sf_dir, f"{base}/raw", f"file_idx % {BUNDLES} >= 4")
    api.build_training_set(spark, inputs, f"{base}/out", window=WIDE, sample_files=None)
    report = api.reconcile_counts(spark, inputs, f"{base}/out").select("n_in", "n_out", "verdict")
    weight = api.training_rows(spark, f"{base}/out").groupBy(F.round(F.col("weight").cast("double"), 9).alias("weight")).agg(F.sum("total_hits").alias("n_hits"), F.count_distinct("file_idx").alias("n_files"))
    return report.join(F.broadcast(weight))  # one row each


@query
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files one level deep for half of the bundles, listed and checked; then flat ones come, and only these are checked."""
    base = f"{scratch(spark)}/inventory-{uuid.uuid4().hex}"
    folders = {"captures": f"{base}/raw/captures"}
    _bundled(spark, sf_dir, f"{base}/raw", f"file_idx % {BUNDLES} < 4", ("captures",))
    first = inventory.refresh(spark, folders, f"{base}/state").select("path", F.lit(True).alias("_old"))
    rest = _raw_tables(spark, sf_dir)["captures"].where(f"file_idx % {BUNDLES} >= 4")
    rest.repartition("file_idx").drop("file_idx").write.mode("append").parquet(f"{base}/raw/captures")
    both = inventory.refresh(spark, folders, f"{base}/state").where("n_read > 0").join(first, "path", "left").withColumn("run", F.regexp_extract("name", "^run=(.*)/", 1))
    return both.groupBy("run", "state", F.col("_old").isNull().alias("is_new")).agg(F.sum("n_read").alias("n_read"), F.sum(F.size("holds")).alias("n_files"))


@query
def missing_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of hits against the captures of four files in five: the others have no capture group."""
    files = views.photons(spark, sf_dir).select("file_idx").distinct()
    per_file = reconcile.distinct_captures(views.captures(spark, sf_dir).where("file_idx % 5 <> 0"))
    return reconcile.with_missing_files(per_file, files)


@query
def stale_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved events that are gone when every seventh file is."""
    nc = views.captures(spark, sf_dir)
    return split.stale_rows(split.group_split(nc), nc.where("file_idx % 7 <> 0"), ("file_idx", "evtid")).groupBy("file_idx", "split").agg(F.count("*").alias("n"))


@query
def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary through its JSON file, then extended by the names of all files: what is known keeps its id."""
    path = f"{scratch(spark)}/dictionary-{uuid.uuid4().hex}"
    local = views.local_dictionary(spark, sf_dir, "volume")
    sinks.write_dictionary(dictionary.extend(dictionary.collect_names(local.where("file_idx = 0"))), path)
    return dictionary.extend(dictionary.collect_names(local), readers.read_dictionary(spark, path))


@query
def dictionary_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs extend one dictionary from the same version: the second finds its number taken and adds to the first one's."""
    path = f"{scratch(spark)}/names-{uuid.uuid4().hex}"
    named = views.captures(spark, sf_dir).select("file_idx", F.col("phys_volume").alias("name")).distinct()
    of = lambda n: named.where(F.col("file_idx") < n).select("name").distinct()
    start = names.grow(spark, path, of(1))
    late = dictionary.extend(named.select("name").distinct(), start)  # worked out before the other job is done
    names.grow(spark, path, of(3))
    if names.take(spark, path, 2, late):
        raise AssertionError("version 2 was taken twice")
    return names.grow(spark, path, named.select("name").distinct())


@query
def bucketed_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`time_window_join` over captures and hits written in buckets of the capture key: nothing is shuffled after that."""
    at = uuid.uuid4().hex
    tables = {k: bucketed.write(rows, f"hitlake_{k}_{at}", f"{scratch(spark)}/bucketed-{k}-{at}", 16) for k, rows in (("captures", views.captures(spark, sf_dir)), ("photons", views.photons(spark, sf_dir)))}
    nc = match.dedup_last_wins(tables["captures"])
    return match.time_window_join(match.detector_filter(tables["photons"]), nc).select("photon_id", *KEY, "time")


@query
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names by (length, name), written in ranges and read back with their places."""
    path = f"{scratch(spark)}/ordered-{uuid.uuid4().hex}"
    rows = views.captures(spark, sf_dir).select(F.col("phys_volume").alias("name")).distinct().withColumn("n_chars", F.length("name"))
    sinks.write_ordered(rows, path, "n_chars", "name")
    return readers.read_ordered(spark, path)


@query
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yield summary through its JSON report."""
    path, row = f"{scratch(spark)}/summary-{uuid.uuid4().hex}", photon_yield_summary(spark, sf_dir)
    sinks.write_json_report(row, path)
    return readers.read_json_report(spark, path, row.schema)


@query
def geometry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume names out of a written geometry text, with their place by (length, name)."""
    path = f"{scratch(spark)}/geometry-{uuid.uuid4().hex}"
    views.captures(spark, sf_dir).select(F.concat(F.lit('  <physvol name="'), "phys_volume", F.lit('" copynumber="1">')).alias("value")).write.text(path)
    names = groups.extract_names(readers.read_lines(spark, path))
    return names.select("name", F.length("name").alias("n_chars"))


@query
def unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report of names without a group."""
    path = f"{scratch(spark)}/report-{uuid.uuid4().hex}"
    groups.write_report(unmatched_names(spark, sf_dir), path)
    return readers.read_lines(spark, path)
