"""Work that the whole jobs over raw files do once, not once a batch, a side of a join or a query."""

import pytest

from hitlake.operators import nearest
from hitlake.plans import api, build, catalogue
from hitlake.sources import inventory
from hitlake.sources.scratch import in_turn, together
from tests.test_inventory import add_files, states, table


def test_batches_share_one_search(spark, tmp_path, monkeypatch):
    inputs, made, levels = add_files(spark, str(tmp_path), range(4)), [], nearest.levels
    api.build_training_set(spark, inputs, str(tmp_path / "whole"))
    monkeypatch.setattr(nearest, "levels", lambda *a: made.append(1) or levels(*a))
    api.build_training_set(spark, inputs, str(tmp_path / "parts"), files_per_batch=1)
    assert len(made) == 1
    assert table(spark, str(tmp_path / "parts")) == table(spark, str(tmp_path / "whole"))
    assert states(spark, str(tmp_path / "parts")) == states(spark, str(tmp_path / "whole"))


def test_hits_are_matched_and_searched_once(spark, tmp_path):
    hits = spark.createDataFrame([(0, 1, 2, 1965, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 20.0)], "file_idx int, evtid long, nc_id long, det_uid int, x float, y float, z float, px float, py float, pz float, time double")
    hits.write.parquet(str(tmp_path / "hits"))
    slots = [{"e": 1.0, "px": 0.0, "py": 0.0, "pz": 1.0}] * 4
    kind = "file_idx int, evtid long, nc_id long, row_ix long, x double, y double, z double, nc_time double, gamma_amount int, gamma_total double, mat_id int, vol_id int, gammas array<struct<e:double,px:double,py:double,pz:double>>"
    captures = spark.createDataFrame([(0, 1, 2, 0, 0.0, 0.0, 0.0, 10.0, 1, 5.0, 1, 1, slots)], kind)
    voxels = spark.createDataFrame([(0, "a", [900.0, 0.0, 0.0], "wall")], "ord int, index string, center array<double>, layer string")
    splits = spark.createDataFrame([(0, 1, "train")], "file_idx int, evtid long, split string")
    rows = build.training_set(spark.read.parquet(str(tmp_path / "hits")), captures, voxels, splits)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "det_uid" in line for line in plan.splitlines()) == 1
    row = rows.first()
    assert (row["total_hits"], row["wall"], row["voxels_hit"], row["voxel_hits"], row["split"]) == (1, 1, 1, {"a": 1}, "train")


@pytest.mark.parametrize("name", ["reset_build", "resumed_build"])
def test_second_jobs_build_only_what_they_return(spark, tmp_path, monkeypatch, name):
    built = []
    rows = "cast(1 as int) as file_idx, 1L as evtid, 1L as nc_id, 'train' as split, 1 as total_hits"

    def fake(spark, inputs, output, **more):
        built.append(output)
        spark.range(1).selectExpr(*rows.split(", ")).write.mode("overwrite").parquet(f"{output}/rows")

    monkeypatch.setattr(catalogue, "_raw_files", lambda *a: None)
    for cache in ("_raw", "_written"):
        monkeypatch.setattr(catalogue, cache, {})
    monkeypatch.setattr(api, "build_training_set", fake)
    monkeypatch.setattr(api, "training_rows", lambda spark, out: spark.read.parquet(f"{out}/rows"))
    monkeypatch.setattr(catalogue, "_row_summary", lambda rows: rows)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 1
    assert len(built) == 2 and len(set(built)) == 1  # not a third one for its raw files


def test_text_is_no_parquet_file_at_a_glance(spark, tmp_path, monkeypatch):
    """No footer is looked for in a file that does not end like one."""
    inputs = add_files(spark, str(tmp_path), range(1))
    (tmp_path / "captures" / "note.parquet").write_text("this is no record")
    monkeypatch.setattr(inventory, "_valid_and_empty", None)
    found = inventory.refresh(spark, {"captures": inputs.captures}, str(tmp_path / "state"))
    assert {r["name"]: r["state"] for r in found.collect()} == {"run000/output_0.parquet": "ok", "note.parquet": "unreadable"}


def test_bundles_are_written_by_a_task_each(spark, tmp_path):
    """Hashing put some of the bundles into one task and left others idle."""
    catalogue._bundled(spark, "/root/testdata/sf0.001", str(tmp_path), kinds=("photons",))
    places = [int(f.name.split("-")[1]) for f in tmp_path.glob("photons/run=*/part-*.parquet")]
    assert places and len(set(places)) == len(places)


def test_steps_together_and_in_turn(spark):
    assert together(spark, lambda: 1, lambda: "b") == [1, "b"]
    assert list(in_turn(spark, lambda i: i * i, 7)) == [0, 1, 4, 9, 16, 25, 36] and list(in_turn(spark, lambda i: i, 0)) == []
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 / 0)


def test_a_file_of_many_batches_is_read_once_a_group(spark, tmp_path, monkeypatch):
    """Eight logical files in one physical file of each kind, a batch each: it was read for every batch."""
    assert api.grouped(0) == [] and api.grouped(1) == [(0, 0)] and api.grouped(8) == [(0, 0), (1, 2), (3, 6), (7, 7)]
    parts = add_files(spark, str(tmp_path / "parts"), range(8))
    inputs = api.Inputs(*(str(tmp_path / "one" / k) for k in parts.folders()), parts.voxels)
    for kind, folder in inputs.folders().items():
        spark.read.parquet(f"{parts.folders()[kind]}/run*").coalesce(1).write.parquet(folder)
    api.build_training_set(spark, inputs, str(tmp_path / "whole"))
    opened, rows = [], api._Job.rows
    monkeypatch.setattr(api._Job, "rows", lambda job, kind, files: opened.append(kind) or rows(job, kind, files))
    api.build_training_set(spark, inputs, str(tmp_path / "one by one"), files_per_batch=1)
    assert opened.count("photons") == 4
    assert table(spark, str(tmp_path / "one by one")) == table(spark, str(tmp_path / "whole"))
    assert states(spark, str(tmp_path / "one by one")) == states(spark, str(tmp_path / "whole"))
    assert len({r["batch"] for r in spark.read.parquet(str(tmp_path / "one by one" / "record")).where("status = 'completed'").collect()}) == 8
