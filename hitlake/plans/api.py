"""Whole jobs from paths to results, for use without the operators behind them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.operators import dictionary, groups, nearest, ranks, reconcile, split, stats, targets
from hitlake.plans import build
from hitlake.schema import KEY, Geometry
from hitlake.sources import inventory, readers, sinks
from hitlake.sources import names as version
from hitlake.sources.scratch import existing, in_turn, materialise, together


@dataclass(frozen=True)
class Inputs:
    """Folders of raw tables (Parquet, columns of `hitlake.schema`) and local dictionaries, flat or one level deep, and the voxel list (JSON)."""

    captures: str
    photons: str
    materials: str  # source_file, row_ix, local_id, name
    volumes: str
    voxels: str

    def folders(self) -> dict[str, str]:
        return {"captures": self.captures, "photons": self.photons, "materials": self.materials, "volumes": self.volumes}


def _generation(spark: SparkSession, output: str) -> str:
    """The folder of the dictionaries; starting over makes a new one."""
    return f"{output}/{spark.read.text(f'{output}/dictionaries').first()[0]}"


def _indexed(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("source_file", F.col("file_rank").alias("file_idx")), "source_file")


class _Job:
    """One run of the build: the files that are there, what is known of them, and readers that open those needed only."""

    def __init__(self, spark: SparkSession, inputs: Inputs, output: str, reset: bool):
        self.spark, self.inputs, self.output, self.reset = spark, inputs, output, reset
        if reset or existing(lambda: spark.read.text(f"{output}/dictionaries")) is None:
            spark.range(1, numPartitions=1).select(F.lit(f"dictionaries-{uuid.uuid4().hex}").alias("value")).write.mode("overwrite").text(f"{output}/dictionaries")
        self.inventory = inventory.refresh(spark, inputs.folders(), f"{output}/inventory", reset)
        held = self.inventory.select("kind", "path", "seen_at", F.explode("holds").alias("source_file"))
        self.lost, self.held = together(spark, lambda: materialise(inventory.failures(self.inventory)), lambda: materialise(held))
        self._paths: dict[DataFrame, dict[str, list[str] | None]] = {}
        named = self.held.groupBy("source_file").agg(F.max("seen_at").alias("seen_at"), F.max(F.col("kind") == "captures").alias("_own"))
        #: Logical files with captures that no damage touches, and when the last of their parts was found.
        self.present = materialise(named.where("_own").drop("_own").join(self.lost, "source_file", "left_anti"))
        self.files = self._numbered()

    def _left(self, name: str) -> DataFrame | None:
        return None if self.reset else existing(lambda: materialise(self.spark.read.parquet(f"{self.output}/{name}")))

    def _numbered(self) -> DataFrame:
        """(source_file, file_idx): a file keeps its number; new ones follow in path order."""
        known = self._left("files")
        new = self.present.select("source_file") if known is None else self.present.select("source_file").join(known, "source_file", "left_anti")
        begin = 0 if known is None else known.agg(F.coalesce(F.max("file_idx") + 1, F.lit(0))).first()[0]
        rows = materialise(ranks.numbered(new, "source_file", "_place").select("source_file", (F.col("_place") + begin).cast("int").alias("file_idx")))
        rows.write.mode("overwrite" if known is None else "append").parquet(f"{self.output}/files")
        return rows if known is None else known.unionByName(rows)

    def dictionary(self, column: str) -> str:
        return f"{_generation(self.spark, self.output)}/{column}"

    def paths(self, files: DataFrame) -> dict[str, list[str] | None]:
        """By kind, the physical files that hold some logical ones; None (the whole folder) if they are too many to name."""
        if files not in self._paths:
            kinds, most = self.inputs.folders(), inventory.MOST_PATHS
            found = self.held.join(files, "source_file", "left_semi").select("kind", "path").distinct().limit(len(kinds) * most + 1).collect()
            named = {k: [r["path"] for r in found if r["kind"] == k] for k in kinds}
            whole = len(found) > len(kinds) * most  # then some are left out
            self._paths[files] = {k: None if whole or len(p) > most else p for k, p in named.items()}
        return self._paths[files]

    def rows(self, kind: str, files: DataFrame) -> DataFrame:
        """Raw rows of some logical files (source_file, file_idx), from their physical files only."""
        read = {"captures": readers.read_captures, "photons": readers.read_photons}.get(kind, readers.read_local_names)
        folder = self.inputs.folders()[kind]
        paths = self.paths(files)[kind]
        if paths == []:  # none of them has a file of this kind
            return read(self.spark, folder).where(F.lit(False)).join(files, "source_file")
        return read(self.spark, folder, paths).join(files, "source_file")

    def counts(self) -> DataFrame:
        """(source_file, n_distinct) of all files, kept beside the output: only new and changed files are counted.

        A capture's key belongs to one file, so sums over files are exact distinct counts however they are added up.
        """
        known = self._left("counts")
        same = ["source_file", "seen_at"]
        new = materialise(self.present if known is None else self.present.join(known, same, "left_anti"))
        if known is None or not new.isEmpty():
            per = reconcile.distinct_captures(self.rows("captures", new.join(self.files, "source_file").select("source_file", "file_idx")))
            rows = new.join(self.files, "source_file").join(per, "file_idx").select(*same, "n_distinct")
            rows.write.mode("overwrite" if known is None else "append").parquet(f"{self.output}/counts")
        return materialise(self.spark.read.parquet(f"{self.output}/counts").join(self.present, same, "left_semi").select("source_file", "n_distinct"))

    def known_ids(self, todo: DataFrame) -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
        """Extend both dictionaries by the names of some files; local and global names by column, and the files that cannot be mapped."""
        ids = self.rows("captures", todo).groupBy("file_idx", "mat_local", "vol_local").agg(F.count("*").alias("_n"))

        def grown(column: str) -> tuple[DataFrame, DataFrame]:
            names = materialise(dictionary.last_of_file(self.rows(column, todo)))
            return names, materialise(version.grow(self.spark, self.dictionary(column), materialise(dictionary.collect_names(names, MAPPED[column][2]))))

        ids, *found = together(self.spark, lambda: materialise(ids), *[partial(grown, c) for c in MAPPED])
        known = dict(zip(MAPPED, found))
        for column, (local, out, empty) in MAPPED.items():
            ids = dictionary.remap(ids, *known[column], local, out, empty)
        bad = dictionary.quarantine(ids, ("mat_id", "vol_id")).join(self.files, "file_idx").select("source_file", "reason")
        return known, materialise(bad)

    def split(self, ok: DataFrame, todo: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, bool]:
        """The saved split, or a new one if there is none or one of its events is gone; and whether it is new."""
        event = ("source_file", "evtid")
        saved = None if self.reset else existing(lambda: materialise(sinks.load_split(self.spark, f"{self.output}/split")))
        if saved is not None:
            gone = saved.select("source_file").distinct().join(ok, "source_file", "left_anti")
            again = saved.join(todo, "source_file", "left_semi")  # their events may differ now
            if gone.isEmpty() and (again.isEmpty() or split.stale_rows(again, self.rows("captures", todo), event).isEmpty()):
                return saved, False
        made = materialise(split.group_split(self.rows("captures", ok), fraction, seed, event))
        sinks.save_split(made, f"{self.output}/split", seed, fraction)
        return made, True


#: Local column, global column and the name of an empty entry, by dictionary.
MAPPED = {"materials": ("mat_local", "mat_id", None), "volumes": ("vol_local", "vol_id", "noVolume")}


def build_training_set(
    spark: SparkSession, inputs: Inputs, output: str, *, window: float = 200.0, val_fraction: float = 0.2, seed: int = 42, sample_files: int | None = 50, scale: float = 1000.0,
    geometry: Geometry = Geometry(), primaries: int = 0, reset: bool = False, files_per_batch: int | None = None, most_batches: int | None = None,
) -> DataFrame:
    """Bring the training set and its dimensions under `output` up to date; returns the files that failed (source_file, reason).

    Files that are done and unchanged are skipped; the others are built `files_per_batch` at a time (all at once if not
    given), `most_batches` of them at most. A batch's rows become visible (`training_rows`) with its entry in the record,
    one file written last: a run that is killed anywhere leaves no half batch, and the next one goes on where it stopped.
    Batches are written one by one but worked out ahead in groups of 1, 2, 4, ... (`grouped`): a physical file that holds
    logical files of many batches is read once a group, and no file of a batch that is not asked for is opened.

    Damage of any kind of file (captures, hits, either dictionary) fails the logical files that it touches and no others;
    so do ids that cannot be mapped. Failed files are in the record (`run_record`) and are tried again by the next run. A
    saved split is used again unless one of its events is gone; then all rows are built anew. Dictionaries and file
    numbers only grow. `reset` starts over: inventory, split, dictionaries, rows, dimensions and record are made anew.
    """
    job = _Job(spark, inputs, output, reset)
    record = None if reset else existing(lambda: materialise(sinks.read_record(spark, f"{output}/record")))
    done = None if record is None else record.where("status = 'completed'").select("source_file", "seen_at")
    todo = job.present if done is None else job.present.join(done, ["source_file", "seen_at"], "left_anti")
    todo = materialise(todo.join(job.files, "source_file").select("source_file", "file_idx"))
    job.paths(todo)

    def detector() -> tuple[DataFrame, nearest.Search]:
        voxels = materialise(readers.read_voxels(spark, inputs.voxels))
        build.write_dimensions(output, reset, voxel_metadata=targets.voxel_metadata(voxels), geometry=build.geometry_table(spark, geometry, primaries))
        return voxels, nearest.prepared(voxels)

    per_file, (local, bad), (voxels, search) = together(spark, job.counts, lambda: job.known_ids(todo), detector)
    failed = job.lost.unionByName(bad)
    if done is not None:  # finished once, but the file is no longer there
        failed = failed.unionByName(done.select("source_file").join(job.present, "source_file", "left_anti").join(job.lost, "source_file", "left_anti").withColumn("reason", F.lit("gone")))
    failed = materialise(failed)
    failures = failed.select("source_file", F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("rows_train"), F.lit(0).cast("bigint").alias("rows_validation"), "reason", F.lit(None).cast("string").alias("batch"), F.lit(None).cast("timestamp").alias("seen_at"))
    whole = job.present.join(bad, "source_file", "left_anti").join(job.files, "source_file").select("source_file", "file_idx")
    ok, _ = together(spark, lambda: materialise(whole), lambda: sinks.append_record(failures, f"{output}/record", reset))
    in_order = lambda files: materialise(ranks.numbered(files.join(bad, "source_file", "left_anti"), "source_file", "_place"))
    (splits, new), ordered = together(spark, lambda: job.split(ok, todo, val_fraction, seed), lambda: in_order(todo))
    if new and done is not None:
        (local, _), ordered = job.known_ids(ok), in_order(ok)  # every row may change its side
    weight = split.weight_of_counts(per_file.join(ok, "source_file"), sample_files)
    dictionaries = {c: version.read(spark, job.dictionary(c)) for c in MAPPED}
    build.write_dimensions(output, reset, material_map=dictionaries["materials"], volume_map=dictionaries["volumes"])

    n = ordered.count()
    size = files_per_batch or max(1, n)
    run = uuid.uuid4().hex

    def made(first: int, last: int) -> tuple[DataFrame, DataFrame]:
        """Rows, which nobody sees yet, and entries of the batches first to last, both by `_batch`."""
        mine = ordered.where(F.col("_place").between(first * size, (last + 1) * size - 1))
        mine = materialise(mine.select("source_file", "file_idx", "_place", F.expr(f"cast(_place div {size} as int)").alias("_batch")))
        files = mine.select("source_file", "file_idx")
        nc = job.rows("captures", files)
        for column, (local_id, out, empty) in MAPPED.items():
            names, full = local[column]
            nc = dictionary.remap(nc, names.join(files, "file_idx", "left_semi"), full, local_id, out, empty)
        nc = materialise(nc)  # read by the join with the hits and by the features
        photons = job.rows("photons", files).withColumn("photon_id", F.monotonically_increasing_id())
        sides = splits.join(files, "source_file").select("file_idx", "evtid", "split")
        rows = build.training_set(photons, nc, voxels, sides, window, ("file_idx", "evtid"), scale, geometry, weight=weight, search=search)
        name = F.concat(F.lit(f"{run}-"), F.col("_batch").cast("string")).alias("batch")
        if first == last:
            rows = materialise(rows.select("*", F.lit(f"{run}-{first}").alias("batch"), F.lit(first).alias("_batch")))
        else:  # neighbours in place share a task, so a batch is few files
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            step = F.expr(f"cast((_place - {first * size}) * {tasks} div {(last + 1 - first) * size} as int)")
            named = rows.join(F.broadcast(mine.select("file_idx", "_place", "_batch")), "file_idx").repartitionById(tasks, step)
            rows = materialise(named.sortWithinPartitions("_batch").select(*rows.columns, name, "_batch"), "_batch")
        return rows, materialise(_entries(rows, mine.select("source_file", name, "_batch").join(job.present, "source_file")))

    groups_ = grouped(min(-(-n // size), most_batches if most_batches is not None else n))
    for (first, last), (rows, entries) in zip(groups_, in_turn(spark, lambda g: made(*groups_[g]), len(groups_))):
        for i in range(first, last + 1):
            own = F.col("_batch") == i
            build.write_training_set(rows.where(own).drop("_batch"), f"{output}/rows", reset and i == 0)
            sinks.append_record(entries.where(own).drop("_batch").coalesce(1), f"{output}/record")
    return failed


def grouped(n: int) -> list[tuple[int, int]]:
    """0, ..., n - 1 in groups (first, last) of 1, 2, 4, ...: a group has one more than all groups before it."""
    out, first = [], 0
    while first < n:
        out.append((first, min(2 * first, n - 1)))
        first = out[-1][1] + 1
    return out


def _entries(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The record of batches whose rows are worked out: one row per file."""
    count = lambda name: F.count(F.when(F.col("split") == name, 1))
    per = rows.groupBy("source_file").agg(count("train").alias("rows_train"), count("validation").alias("rows_validation"))
    return files.join(per, "source_file", "left").select(
        "source_file", F.lit("completed").alias("status"), F.coalesce("rows_train", F.lit(0)).alias("rows_train"), F.coalesce("rows_validation", F.lit(0)).alias("rows_validation"), F.lit("").alias("reason"), "batch", "seen_at", "_batch",
    )


def training_rows(spark: SparkSession, output: str) -> DataFrame:
    """The rows of all files that the record names as completed, with the weight of all captures counted so far."""
    record = sinks.read_record(spark, f"{output}/record").where("status = 'completed'").select("source_file", "batch")
    rows = sinks.read_training_set(spark, f"{output}/rows").join(record, ["source_file", "batch"], "left_semi").drop("batch", "weight")
    weight = split.weight_of_counts(_counted(spark, output).join(record, "source_file", "left_semi").withColumn("file_idx", F.lit(0)))
    return rows.join(F.broadcast(weight.select(F.col("weight").cast("float").alias("weight"))))  # one row


def _counted(spark: SparkSession, output: str) -> DataFrame:
    """(source_file, n_distinct) as last counted."""
    return spark.read.parquet(f"{output}/counts").groupBy("source_file").agg(F.max_by("n_distinct", "seen_at").alias("n_distinct"))


def run_record(spark: SparkSession, output: str) -> DataFrame:
    """The last state of every file: completed or failed, rows of both splits, reason."""
    return sinks.read_record(spark, f"{output}/record").select("source_file", "status", "rows_train", "rows_validation", "reason")


def missing_captures(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """Every file of captures or hits with its distinct captures; files without a capture group count 0 and are marked."""
    captures, photons = readers.read_captures(spark, inputs.captures), readers.read_photons(spark, inputs.photons)
    files = readers.manifest(captures.select("source_file").union(photons.select("source_file")))
    per_file = reconcile.distinct_captures(_indexed(captures, files))
    return reconcile.with_missing_files(per_file, files.select("source_file", F.col("file_rank").alias("file_idx")))


def reconcile_counts(spark: SparkSession, inputs: Inputs, output: str) -> DataFrame:
    """Captures of all readable files against the rows written under `output`, from the counts kept there."""
    return reconcile.reconcile_totals(_counted(spark, output), training_rows(spark, output))


def photon_report(spark: SparkSession, inputs: Inputs, n_files: int = 1000, seed: int = 42) -> DataFrame:
    """Yield summary over a fixed-seed sample of files."""
    captures, photons = readers.read_captures(spark, inputs.captures), readers.read_photons(spark, inputs.photons)
    files = readers.sample_files(readers.manifest(captures), n_files, seed)
    nc, hits = (_indexed(t, files) for t in (captures, photons))
    return stats.yield_summary(stats.file_stats(hits, nc), stats.yield_distribution(hits, nc))


def group_spectra(spark: SparkSession, output: str) -> DataFrame:
    """Hit statistics by volume group of a written training set; volumes are named by its own dictionary."""
    names = version.read(spark, f"{_generation(spark, output)}/volumes")
    rows = training_rows(spark, output).select(*KEY, F.col("volID").cast("int").alias("id"), "total_hits", "voxels_hit")
    named = rows.join(dictionary.inverted(names), "id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    return groups.spectrum_stats(named, groups.grouped_names(names))


def dense_targets(spark: SparkSession, output: str, voxels: str, all_captures: bool = False, listed: bool = False) -> DataFrame:
    """The counts of a written training set as one array per capture, in voxel order; with `all_captures` also the zeros of those without hits.

    `listed` gives each array's length and its counts above 0 instead (`targets.dense_rows`).
    """
    rows = training_rows(spark, output).select(*KEY, "voxel_hits")
    return targets.dense_rows(rows if all_captures else rows.where(F.size("voxel_hits") > 0), readers.read_voxels(spark, voxels), listed=listed)


__all__ = ["Inputs", "build_training_set", "dense_targets", "group_spectra", "missing_captures", "photon_report", "reconcile_counts", "run_record", "training_rows"]
