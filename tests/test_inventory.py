"""Damaged raw files, resumed and incremental builds, zero targets."""

import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from hitlake import schema
from hitlake.plans import api
from hitlake.sources import inventory, sinks

SLOT = (100.0, 0.0, 0.0, 1.0)
LOCAL = schema.LOCAL_NAMES


def one_file(spark, rows, kind, path, group=100_000):
    """One Parquet file under a name of its own, with page checksums."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    names = kind.names
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], to_arrow_schema(kind))
    pq.write_table(table, path, row_group_size=group, write_page_checksum=True)


def break_page(path, column, group=-1):
    """Turn bytes of a column's first page in one row group."""
    meta = pq.read_metadata(path)
    at = meta.row_group(group % meta.num_row_groups).column(column)
    with open(path, "r+b") as file:
        file.seek((at.dictionary_page_offset or at.data_page_offset) + at.total_compressed_size - 2)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 0xFF]))


def add_files(spark, base, numbers, named=True):
    """Files of all kinds; the logical name is the path, or a column."""
    for f in numbers:
        name = f"run00{f % 2}/output_{f}.parquet"
        own = name if named else None
        one_file(spark, [(own, e, e, c, 0.0, 0.0, 0.0, 10.0, 1, 5.0, 1 + f, 2, *SLOT * 4, False) for e in range(6) for c in range(2)], schema.RAW_NC, f"{base}/captures/{name}")
        one_file(spark, [(own, e, 0, 1965, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 20.0) for e in range(6)], schema.RAW_OPTICAL, f"{base}/photons/{name}")
        one_file(spark, [(own, 0, 1 + f, f"mat{f % 3}")], LOCAL, f"{base}/materials/{name}")
        one_file(spark, [(own, 0, 2, "V0001")], LOCAL, f"{base}/volumes/{name}")
    with open(f"{base}/voxels.json", "w") as file:
        json.dump([{"index": i, "center": [x, 0, 0], "corners": [[0, 0, 0]], "layer": layer} for i, x, layer in (("0", 900, "wall"), ("1", -900, "pit"))], file)
    return api.Inputs(*(f"{base}/{k}" for k in ("captures", "photons", "materials", "volumes")), f"{base}/voxels.json")


def states(spark, out):
    return {r["source_file"]: (r["status"], r["rows_train"] + r["rows_validation"], r["reason"]) for r in api.run_record(spark, out).collect()}


def table(spark, out):
    return sorted(str(r.asDict()) for r in api.training_rows(spark, out).collect())


def test_every_kind_of_damage_fails_its_file_only(spark, tmp_path):
    inputs = add_files(spark, str(tmp_path), range(6), named=False)
    name = lambda f: f"run00{f % 2}/output_{f}.parquet"
    with open(f"{inputs.photons}/{name(1)}", "wb") as file:
        file.write(b"PAR1 not parquet")
    with open(f"{inputs.materials}/{name(2)}", "r+b") as file:
        file.truncate(os.path.getsize(file.name) - 9)
    break_page(f"{inputs.volumes}/{name(4)}", 3)  # one byte
    out = str(tmp_path / "out")
    failed = {r["source_file"]: r["reason"] for r in api.build_training_set(spark, inputs, out).collect()}
    assert failed == {name(1): "unreadable photons", name(2): "unreadable materials", name(4): "unreadable volumes"}
    assert states(spark, out) == {name(f): ("completed", 12, "") for f in (0, 3, 5)} | {f: ("failed", 0, r) for f, r in failed.items()}
    assert {(r["source_file"], r["total_hits"]) for r in api.training_rows(spark, out).collect()} == {(name(f), h) for f in (0, 3, 5) for h in (0, 1)}
    # Mended files are built by the next run, and the files that are done are left alone.
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/rows/split=*/file_idx=*/*")}
    assert before
    add_files(spark, str(tmp_path), (1, 2, 4), named=False)
    assert api.build_training_set(spark, inputs, out).collect() == []
    assert {s[:2] for s in states(spark, out).values()} == {("completed", 12)} and len(table(spark, out)) == 72
    assert before.items() <= {f: os.path.getmtime(f) for f in glob.glob(f"{out}/rows/split=*/file_idx=*/*")}.items()


def test_a_bundle_damaged_in_its_last_rows(spark, tmp_path):
    """Two logical files in one physical file of hits, cut in its last row group: both fail, also if one is not seen any more."""
    inputs = add_files(spark, str(tmp_path), range(4))
    name = lambda f: f"run00{f % 2}/output_{f}.parquet"
    hits = [(name(f), e, 0, 1965, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 20.0 + e * 1e-7) for f in (0, 1) for e in range(20000)]
    for f in (0, 1):
        os.remove(f"{inputs.photons}/{name(f)}")
    bundle = f"{inputs.photons}/bundle.parquet"
    one_file(spark, hits, schema.RAW_OPTICAL, bundle, group=9_000)
    break_page(bundle, schema.RAW_OPTICAL.names.index("time_in_ns"))
    inv = {r["name"]: (r["state"], r["n_footer"], r["n_read"]) for r in inventory.refresh(spark, inputs.folders(), str(tmp_path / "inv")).where("kind = 'photons'").collect()}
    assert inv["bundle.parquet"][0] == "cut" and 0 < inv["bundle.parquet"][2] < inv["bundle.parquet"][1] == 40000
    failed = {r["source_file"]: r["reason"] for r in api.build_training_set(spark, inputs, str(tmp_path / "out")).collect()}
    assert failed == {n: "cut photons" for n in ("bundle.parquet", name(0), name(1))}
    assert {r["source_file"] for r in api.training_rows(spark, str(tmp_path / "out")).collect()} == {name(2), name(3)}


def test_inventory_checks_new_files_only(spark, tmp_path, monkeypatch):
    inputs = add_files(spark, str(tmp_path), range(2))
    one_file(spark, [(None, 0, 0, "x")], LOCAL, f"{inputs.materials}/deep/er/ignored.parquet")
    spark.createDataFrame([], LOCAL).coalesce(1).write.parquet(f"{inputs.volumes}/none")
    first = inventory.refresh(spark, inputs.folders(), str(tmp_path / "inv"))
    assert first.groupBy("kind", "state").count().orderBy("kind", "state").collect() == [("captures", "ok", 2), ("materials", "ok", 2), ("photons", "ok", 2), ("volumes", "empty", 1), ("volumes", "ok", 2)]
    seen, inspect = [], inventory.inspect
    monkeypatch.setattr(inventory, "inspect", lambda s, kind, folder, paths=None: seen.append((kind, paths and [os.path.basename(p) for p in paths])) or inspect(s, kind, folder, paths))
    add_files(spark, str(tmp_path), [7])
    os.remove(f"{inputs.photons}/run000/output_0.parquet")
    again = inventory.refresh(spark, inputs.folders(), str(tmp_path / "inv"))
    assert sorted(seen) == [(k, ["output_7.parquet"]) for k in sorted(inventory.KINDS)]
    assert again.count() == 9 + 4 - 1


def test_batches_equal_one_build_and_survive_a_kill(spark, tmp_path, monkeypatch):
    inputs = add_files(spark, str(tmp_path), range(5))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    api.build_training_set(spark, inputs, whole)
    append, calls = sinks.append_record, []

    def killed(record, path, fresh=False):
        calls.append(path)
        if len(calls) == 3:  # failed files, first batch, then the rows of the second are there without their entry
            raise KeyboardInterrupt
        append(record, path, fresh)

    monkeypatch.setattr(sinks, "append_record", killed)
    with pytest.raises(KeyboardInterrupt):
        api.build_training_set(spark, inputs, parts, files_per_batch=2)
    monkeypatch.setattr(sinks, "append_record", append)
    assert len({r["source_file"] for r in spark.read.parquet(f"{parts}/rows").collect()}) == 4
    assert len({r["source_file"] for r in api.training_rows(spark, parts).collect()}) == 2
    api.build_training_set(spark, inputs, parts, files_per_batch=2)
    assert table(spark, parts) == table(spark, whole)
    assert states(spark, parts) == states(spark, whole)


def test_new_files_are_added_and_a_lost_one_starts_a_new_split(spark, tmp_path):
    inputs, out = add_files(spark, str(tmp_path), range(3)), str(tmp_path / "out")
    api.build_training_set(spark, inputs, out)
    first = {r["source_file"]: r["file_idx"] for r in api.training_rows(spark, out).collect()}
    add_files(spark, str(tmp_path), [4])  # sorts between the others
    api.build_training_set(spark, inputs, out)
    rows = api.training_rows(spark, out).collect()
    assert {r["source_file"]: r["file_idx"] for r in rows} == first | {"run000/output_4.parquet": 3}
    assert {r["split"] for r in rows if r["file_idx"] == 3} == {"train"}  # the saved split does not know it
    assert rows[0]["weight"] == pytest.approx(1 / 48) and api.reconcile_counts(spark, inputs, out).first()["n_in"] == 48
    for kind in inputs.folders().values():
        os.remove(f"{kind}/run000/output_2.parquet")
    api.build_training_set(spark, inputs, out)
    rows = api.training_rows(spark, out).collect()
    events = {(r["source_file"], r["evtid"]): r["split"] for r in rows}
    assert len(rows) == 36 and len(events) == 18 and sum(s == "train" for s in events.values()) == 14
    assert states(spark, out)["run000/output_2.parquet"] == ("failed", 0, "gone")


def test_zero_targets_and_wide_detectors(spark, tmp_path, monkeypatch):
    from hitlake.operators import targets

    inputs, out = add_files(spark, str(tmp_path), range(2)), str(tmp_path / "out")
    api.build_training_set(spark, inputs, out)
    rows = api.dense_targets(spark, out, inputs.voxels, all_captures=True).collect()
    assert len(rows) == 24 and sorted({tuple(r["target"]) for r in rows}) == [(0, 0), (1, 0)]
    assert len(api.dense_targets(spark, out, inputs.voxels).collect()) == 12
    monkeypatch.setattr(targets, "CELLS", 70_000)
    voxels = spark.range(30_000).selectExpr("cast(id as int) as ord", "concat('v', id % 29000) as index")  # repeated names
    maps = spark.createDataFrame([(0, 1, 2, {"v7": 3, "v28999": 4, "-1": 9}), (0, 1, 3, {}), (0, 1, 4, None)] + [(1, i, 0, {f"v{i}": i + 1}) for i in range(50)], "file_idx int, evtid long, nc_id long, voxel_hits map<string,int>")
    got = {(r["file_idx"], r["evtid"], r["nc_id"]): r["target"] for r in targets.dense_rows(maps, voxels).collect()}
    assert {len(t) for t in got.values()} == {29000} and len(got) == 53
    assert {i: n for i, n in enumerate(got[0, 1, 2]) if n} == {7: 3, 28999: 4} and not any(got[0, 1, 3]) and not any(got[0, 1, 4])
    assert all(got[1, i, 0][i] == i + 1 and sum(got[1, i, 0]) == i + 1 for i in range(50))


def test_two_jobs_extend_one_dictionary(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from hitlake.sources import names

    path = str(tmp_path / "names")
    make = lambda *found: spark.createDataFrame([(n,) for n in found], "name string")
    assert names.read(spark, path) is None
    take, raced = names.take, []

    def slow(spark, path, number, full):
        if not raced:  # another job comes between reading and writing
            raced.append(names.grow)
            monkeypatch.setattr(names, "take", take)
            names.grow(spark, path, make("c", "a"))
        return take(spark, path, number, full)

    monkeypatch.setattr(names, "take", slow)
    assert {r["name"]: r["id"] for r in names.grow(spark, path, make("b", "a", "")).collect()} == {"a": 1, "c": 2, "": 3, "b": 4}
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: names.grow(spark, path, make(*[f"{k}{i}" for i in range(5)], "a")), "xyz"))
    rows = names.read(spark, path).collect()
    assert len(rows) == 19 and sorted(r["id"] for r in rows) == list(range(1, 20))


def test_bucketed_join_shuffles_no_hits(spark, tmp_path):
    from hitlake.operators import match
    from hitlake.plans.catalogue import QUERIES, _deduped
    from hitlake.sources import bucketed, views

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large to send
    found = QUERIES["bucketed_window_join"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = match.time_window_join(match.detector_filter(views.photons(spark, sf)), _deduped(spark, sf)).select("photon_id").collect()
    assert sorted(r["photon_id"] for r in found.collect()) == sorted(r["photon_id"] for r in want)
    again = bucketed.write(spark.range(10).selectExpr("cast(id as int) as file_idx", "id as evtid", "id as nc_id"), "hitlake_again", str(tmp_path / "again"), 4)
    assert again.count() == 10
