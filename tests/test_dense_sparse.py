"""Dense targets and what is read out of them; folders of the incremental build."""

import glob

from pyspark.sql import functions as F

from hitlake.operators import targets
from hitlake.plans.build import write_training_set
from hitlake.sources import sinks
from hitlake.streaming import incremental

KEYS = ("k",)


def test_sparse_rows_give_back_what_dense_rows_hold(spark):
    voxels = spark.createDataFrame([(i, str(i)) for i in range(7)], "ord int, index string")
    rows = spark.createDataFrame([(1, {"0": 2, "6": 1}), (2, {}), (3, {"3": 5, "x": 9}), (4, None)], "k int, voxel_hits map<string,int>")
    dense = targets.dense_rows(rows, voxels, KEYS)
    found = {r["k"]: (r["n_voxels"], [tuple(p) for p in r["hit"]]) for r in targets.sparse_rows(dense, KEYS).collect()}
    at_once = {r["k"]: (r["n_voxels"], [tuple(p) for p in r["hit"]]) for r in targets.dense_rows(rows, voxels, KEYS, listed=True).collect()}
    assert found == at_once == {1: (7, [(0, 2), (6, 1)]), 2: (7, []), 3: (7, [(3, 5)]), 4: (7, [])}


def test_dense_targets_are_made_in_as_many_tasks_as_there_are_partitions(spark):
    voxels = spark.createDataFrame([(i, str(i)) for i in range(5)], "ord int, index string")
    hits = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 5).cast("string").alias("voxel_index"), F.lit(2).alias("hits"))
    full = targets.dense_target(hits.unionByName(hits.withColumn("voxel_index", F.lit("gone"))), voxels, KEYS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert full.withColumn("t", F.spark_partition_id()).select("t").distinct().count() == tasks
    assert {(r["k"], tuple(r["target"])) for r in full.collect()} == {(i, tuple(2 * (j == i % 5) for j in range(5))) for i in range(400)}


def test_a_partition_is_written_as_one_file(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 10).cast("int").alias("file_idx"), "id", F.lit("train").alias("split")).repartition(4)
    write_training_set(rows, str(tmp_path / "out"))
    assert len(glob.glob(f"{tmp_path}/out/split=*/file_idx=*/*.parquet")) == 10


def test_incremental_folders_follow_batches_not_files(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(600).select((F.col("id") % 50).cast("int").alias("file_idx"), "id", F.when(F.col("id") % 3 == 0, "validation").otherwise("train").alias("split"))
    rows.repartition(4, "file_idx").write.parquet(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        incremental.incremental_build(spark, f"{base}/in", rows.schema, f"{base}/state", f"{base}/out", lambda batch: batch, files_per_batch=3)
    assert spark.read.parquet(f"{base}/out").select("id").distinct().count() == spark.read.parquet(f"{base}/out").count() == 600
    assert len(glob.glob(f"{base}/out/batch=*/split=*")) == 4


def test_listed_targets_make_no_arrays_of_zeros(spark, monkeypatch):
    """They once cost captures times voxels."""
    wide = 100_000
    voxels = spark.range(wide).select(F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("index"))
    entries = [(F.col("id") * 500).cast("string"), F.lit(3), F.lit("7"), F.lit(1), F.lit("8"), F.lit(0), F.lit("gone"), F.lit(4)]
    rows = spark.range(200).select(F.col("id").alias("k"), F.create_map(*entries).alias("voxel_hits"))
    full = targets.sparse_rows(targets.dense_rows(rows, voxels, KEYS), KEYS)
    want = {i: (wide, sorted([(7, 1), (i * 500, 3)])) for i in range(200)}
    found = lambda df: {r["k"]: (r["n_voxels"], [tuple(p) for p in r["hit"]]) for r in df.collect()}
    assert found(full) == want
    monkeypatch.setattr(targets, "CELLS", None)  # blocks of zeros cannot be made without it
    assert found(targets.dense_rows(rows, voxels, KEYS, listed=True)) == want


def test_a_folder_a_file_is_not_a_task_a_folder(spark, tmp_path):
    """Thousands of folders were listed by as many tasks, which took longer than reading them."""
    path = str(tmp_path / "out")
    rows = spark.range(60).select((F.col("id") % 60).cast("int").alias("file_idx"), "id", F.explode(F.array(F.lit("train"), F.lit("validation"))).alias("split"))
    write_training_set(rows, path)
    context, listing = spark.sparkContext, spark.conf.get(sinks.LISTING)
    context.setJobGroup("listing", "folders")
    assert sinks.read_training_set(spark, path).count() == 120
    stages = [s for j in context.statusTracker().getJobIdsForGroup("listing") for s in context.statusTracker().getJobInfo(j).stageIds]
    tasks = [context.statusTracker().getStageInfo(s).numTasks for s in stages]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 60
    assert spark.conf.get(sinks.LISTING) == listing
