"""Whole jobs over small raw files."""

import dataclasses
import json

import pytest

from hitlake import schema
from hitlake.plans import api


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("raw"))
    path = lambda f: f"sim/run001/output_{f}"
    slot = (100.0, 0.0, 0.0, 1.0)
    captures = [(path(f), e, e, c, 0.0, 0.0, 0.0, 10.0, 1, 5.0, 1 + f, 2, *slot * 4, False) for f in range(3) for e in range(5) for c in range(2)]
    spark.createDataFrame(captures, schema.RAW_NC).write.parquet(f"{base}/captures")
    hits = [(path(f), e, 0, 1965, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 20.0) for f in range(3) for e in range(5)]
    spark.createDataFrame(hits, schema.RAW_OPTICAL).write.parquet(f"{base}/photons")
    kind = "source_file string, row_ix long, local_id int, name string"
    materials = [(path(f), 0, 1 + f, "Ge") for f in range(2)] + [(path(0), 1, 9, "LAr")]  # file 2 has no entry
    spark.createDataFrame(materials, kind).write.parquet(f"{base}/materials")
    spark.createDataFrame([(path(f), 0, 2, "" if f else "V0001") for f in range(3)], kind).write.parquet(f"{base}/volumes")
    with open(f"{base}/voxels.json", "w") as file:
        json.dump([{"index": "0", "center": [900, 0, 0], "corners": [[0, 0, 0]], "layer": "wall"}, {"index": "1", "center": [-900, 0, 0], "corners": [[0, 0, 0]], "layer": "pit"}], file)
    return api.Inputs(f"{base}/captures", f"{base}/photons", f"{base}/materials", f"{base}/volumes", f"{base}/voxels.json")


def test_build_reconcile_and_spectra(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    bad = api.build_training_set(spark, raw, out).collect()
    assert [(r["source_file"], r["reason"]) for r in bad] == [("sim/run001/output_2", "unmapped mat_id")]
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert len(rows) == 20 and sum(r["wall"] for r in rows) == 10 and sum(r["pit"] for r in rows) == 0
    split = {(r["file_idx"], r["evtid"]): r["split"] for r in rows}
    assert len(split) == 10 and sum(s == "train" for s in split.values()) == 8
    assert rows[0]["weight"] == pytest.approx(1 / 20)
    # A second run changes nothing: the split and the dictionaries are used again.
    api.build_training_set(spark, raw, out, seed=7)
    again = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    report = api.reconcile_counts(spark, raw, out).first()
    assert (report["n_in"], report["n_out"], report["verdict"]) == (30, 20, "loss")
    record = {r["source_file"]: (r["status"], r["rows_train"] + r["rows_validation"], r["reason"]) for r in api.run_record(spark, out).collect()}
    assert record == {f"sim/run001/output_{f}": ("completed", 10, "") for f in range(2)} | {"sim/run001/output_2": ("failed", 0, "unmapped mat_id")}
    assert {tuple(r["target"]) for r in api.dense_targets(spark, out, raw.voxels).collect()} == {(1, 0)}
    spectra = {r["group_name"]: r["n_events"] for r in api.group_spectra(spark, out).collect()}
    assert spectra == {"V_detector": 10, "noVolume": 10}
    assert api.photon_report(spark, raw, n_files=2).first()["n_photons"] == 10


def test_a_damaged_file_does_not_stop_the_others(spark, raw, tmp_path):
    import shutil

    shutil.copytree(raw.captures, tmp_path / "captures")
    (tmp_path / "captures" / "part-damaged.parquet").write_bytes(b"PAR1 not parquet")
    inputs = dataclasses.replace(raw, captures=str(tmp_path / "captures"))
    api.build_training_set(spark, inputs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 20
    failed = {r["source_file"].rpartition("/")[2]: r["reason"] for r in api.run_record(spark, str(tmp_path / "out")).where("status = 'failed'").collect()}
    assert failed == {"output_2": "unmapped mat_id", "part-damaged.parquet": "unreadable"}


def test_damaged_split_is_an_error_not_a_fresh_start(spark, raw, tmp_path):
    out = tmp_path / "out"
    (out / "split").mkdir(parents=True)
    (out / "split" / "part-0.parquet").write_bytes(b"nonsense")
    with pytest.raises(Exception):
        api.build_training_set(spark, raw, str(out))


def test_reset_starts_over(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    api.build_training_set(spark, raw, out, val_fraction=0.5)
    api.build_training_set(spark, raw, out, val_fraction=0.2, reset=True)
    events = {(r["file_idx"], r["evtid"], r["split"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert len(events) == 10 and sum(s == "train" for _, _, s in events) == 8


def test_missing_capture_group(spark, raw):
    lost = {r["source_file"]: (r["n_distinct"], r["missing"]) for r in api.missing_captures(spark, raw).collect()}
    assert lost == {f"sim/run001/output_{f}": (10, False) for f in range(3)}
