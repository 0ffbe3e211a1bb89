"""Hand-computed cases of boundary semantics (FIXTURES section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from hitlake.functions import bins
from hitlake.functions import geometry as geo
from hitlake.operators import dictionary, groups, match, nearest, reconcile, split, stats, targets

PHOTON = "photon_id string, file_idx int, evtid long, nc_id long, det_uid int, x float, y float, z float, px float, py float, pz float, time double"


def photon(i, t=0.0, nc=7, x=0.0, y=0.0, z=0.0, p=(0.0, 0.0, 0.0), evt=1, det=1965):
    return (str(i), 0, evt, nc, det, x, y, z, *p, t)


@pytest.fixture(scope="module")
def captures(spark):
    return lambda rows: spark.createDataFrame(rows, "file_idx int, evtid long, nc_id long, row_ix int, nc_time double")


@pytest.mark.parametrize("time, kept", [(100.0, True), (300.0, True), (300.5, False), (99.5, False)])
def test_window_is_closed(spark, captures, time, kept):
    hits = spark.createDataFrame([photon(1, time)], PHOTON)
    assert match.time_window_join(hits, captures([(0, 1, 7, 0, 100.0)])).count() == kept


@pytest.mark.parametrize(
    "z, xy, p, kept",
    [
        (-4.979, (0, 0), (0, 0, 0.0), True), (-4.979, (0, 0), (0, 0, 0.1), False), (3.919, (0, 0), (0, 0, 0.0), True), (3.919, (0, 0), (0, 0, -0.1), False),
        (0.0, (0.003, 0.004), (1, -1, 0), False), (0.0, (0, 0), (-1, -1, -1), True), (math.nan, (1, 0), (1, 0, 0), False),
    ],
)
def test_direction(spark, z, xy, p, kept):
    hits = spark.createDataFrame([photon(1, x=float(xy[0]), y=float(xy[1]), z=z, p=tuple(map(float, p)))], PHOTON)
    assert match.direction_filter(match.valid_rows(hits)).count() == kept


def test_last_capture_wins(spark, captures):
    nc = match.dedup_last_wins(captures([(0, 1, 7, 0, 10.0), (0, 1, 7, 1, 50.0)]))
    assert match.time_window_join(spark.createDataFrame([photon(1, 30.0)], PHOTON), nc).count() == 0


def test_two_kinds_of_orphan(spark, captures):
    hits = spark.createDataFrame([photon(1, nc=5), photon(2, nc=-1)], PHOTON)
    nc = captures([(0, 1, 7, 0, 0.0)])
    assert match.orphans_unmatched(hits, nc).count() == 2
    assert match.orphans_sentinel(hits).count() == 1


def test_yield_is_a_full_outer_join(spark, captures):
    hits = spark.createDataFrame([photon(1, nc=1), photon(2, nc=1), photon(3, nc=9)], PHOTON)
    nc = captures([(0, 1, 1, 0, 0.0), (0, 1, 2, 0, 0.0)])
    assert {r["nc_id"]: r["n_photons"] for r in stats.yield_distribution(hits, nc).collect()} == {1: 2, 2: 0, 9: 1}
    row = stats.file_stats(hits, nc).first()
    assert (row["n_with_photons"], row["n_zero"]) == (2, 1)


def test_gamma_slots_and_mean(spark):
    kind = "gammas array<struct<e: double, px: double, py: double, pz: double>>"
    df = spark.createDataFrame([([(100.0, 3.0, 4.0, 1.0), (0.0, 1.0, 1.0, 1.0), (-1.0, 9.0, 9.0, 9.0), (300.0, 0.0, 5.0, 3.0)],)], kind)
    slots = geo.gamma_slots(F.col("gammas"))
    row = df.select(slots.alias("s"), geo.mean_direction(slots, "r").alias("r"), geo.mean_direction(slots, "z").alias("z")).first()
    assert [tuple(g) for g in row["s"]][1:3] == [(0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)]
    assert (row["r"], row["z"]) == (5.0, 2.0)


def _capture(spark, **over):
    base = {"file_idx": 0, "evtid": 1, "nc_id": 1, "x": 0.003, "y": 0.004, "z": -4.979, "mat_id": 1, "vol_id": 1, "gamma_amount": -1, "gamma_total": -3.5, "gammas": [(0.0, 0.0, 0.0, 0.0)] * 4} | over
    kind = "file_idx int, evtid long, nc_id long, x double, y double, z double, mat_id int, vol_id int, gamma_amount int, gamma_total double, gammas array<struct<e: double, px: double, py: double, pz: double>>"
    return spark.createDataFrame([tuple(base.values())], kind)


def test_features(spark):
    row = targets.features(_capture(spark)).first().asDict()
    assert (row["#gamma"], row["E_gamma_tot_keV"]) == (0.0, 0.0)
    assert [round(row[c], 3) for c in ("r_NC_mm", "dist_to_wall_mm", "dist_to_bot_mm", "dist_to_top_mm")] == [5.0, 4295.0, 0.0, 8898.0]
    assert row["phi_NC_rad"] == pytest.approx(math.atan2(4, 3), abs=1e-6)
    unscaled = targets.features(_capture(spark, x=3.0, y=4.0, z=-4979.0), scale=1.0).first().asDict()
    assert unscaled["r_NC_mm"] == 5.0 and unscaled["dist_to_bot_mm"] == 0.0


VOXEL = "ord int, index string, center array<double>, layer string"


def test_nearest_tie_goes_to_the_first(spark):
    voxels = spark.createDataFrame([(0, "a", [0.0, 0.0, 0.0], "WALL"), (1, "b", [10.0, 0.0, 0.0], "other")], VOXEL)
    hits = spark.createDataFrame([photon(1, x=5.0), photon(2, x=5.1), photon(3, x=900.0)], PHOTON)
    for found in (nearest.nearest_brute(hits, voxels), nearest.nearest_grid(hits, voxels), nearest.nearest_grid(hits, voxels, 0.5)):
        assert {r["photon_id"]: r["voxel_index"] for r in found.collect()} == {"1": "a", "2": "b", "3": "b"}


def test_regions(spark):
    voxels = spark.createDataFrame([(0, "v1", [0.0] * 3, "WALL"), (1, "v2", [0.0] * 3, "other"), (2, "v1", [0.0] * 3, "pit")], VOXEL)
    hits = spark.createDataFrame([(0, 1, 1, "v1", 2), (0, 1, 1, "v2", 3)], "file_idx int, evtid long, nc_id long, voxel_index string, hits int")
    row = targets.region_hits(hits, voxels).first()
    assert (row["wall"], row["pit"], row["bot"], row["top"], row["total_hits"]) == (2, 0, 0, 0, 5)
    assert targets.dense_target(hits, voxels.where("ord < 2")).first()["target"] == [2, 3]


def test_dictionary_extension(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 4)], "name string, id int")
    names = dictionary.collect_names(spark.createDataFrame([("d",), ("c",), ("",)], "name string"))
    assert {r["name"]: r["id"] for r in dictionary.extend(names, existing).collect()} == {"a": 1, "b": 4, "c": 5, "d": 6, "noVolume": 7}


def test_quarantine(spark):
    rows = spark.createDataFrame([(0, 1), (1, None)], "file_idx int, mat_id int")
    assert [tuple(r) for r in dictionary.quarantine(rows, ("mat_id",)).collect()] == [(1, "unmapped mat_id", 1)]


@pytest.mark.parametrize("events, fraction", [(10, 0.2), (7, 0.5), (1, 0.2), (333, 0.37)])
def test_split_is_exact_and_keeps_events_together(spark, events, fraction):
    nc = spark.createDataFrame([(i % 3, i, j) for i in range(events) for j in range(2)], "file_idx int, evtid long, nc_id long")
    rows = split.group_split(nc, fraction).collect()
    assert len(rows) == events == len({(r["file_idx"], r["evtid"]) for r in rows})
    assert sum(r["split"] == "train" for r in rows) == int(events * (1 - fraction) + 1e-9)


def test_split_reuse_and_staleness(spark):
    nc = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "file_idx int, evtid long, nc_id long")
    saved = spark.createDataFrame([(0, 1, "validation"), (0, 5, "train")], "file_idx int, evtid long, split string")
    assert {r["evtid"]: r["split"] for r in split.reuse_split(nc, saved, ("file_idx", "evtid")).collect()} == {1: "validation", 2: "train"}
    assert [r["evtid"] for r in split.stale_rows(saved, nc, ("file_idx", "evtid")).collect()] == [5]


def test_weights(spark):
    nc = spark.createDataFrame([(i // 8, i, 0) for i in range(1600)], "file_idx int, evtid long, nc_id long")
    row = split.event_weight(nc, ("file_idx", "evtid", "nc_id"), first_files=50).first()
    assert row["n_distinct"] == 400 and row["weight"] == pytest.approx(1 / 1600)
    assert split.event_weight(nc.limit(0), ("file_idx", "evtid", "nc_id")).first()["weight"] == 1.0


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,), (-1.0,), (None,)], "v double")
    assert [r["n"] for r in bins.histogram(df, "v", [0.0, 5.0, 10.0]).orderBy("bin").collect()] == [1, 2]
    assert bins.symmetric_log(-100.0, 100.0, 3) == sorted(bins.symmetric_log(-100.0, 100.0, 3))


@pytest.mark.parametrize("name, group", [("V0605", "V_detector"), ("V0605_pen", "V_penetration"), ("PMT123456", "PMT_main"), ("PMT3001234", "PMT_3inch"), ("", "unmatched"), ("tank", "tank"), ("V0001_hv_clamp_string_9", "V_hv_clamp_string_9"), ("V0001_hv_clamp_string_0", "unmatched")])
def test_groups(spark, name, group):
    assert spark.createDataFrame([(name,)], "name string").select(groups.assign_group(F.col("name"))).first()[0] == group


def test_number_of_rules():
    assert len(groups.rules()) == 78 and len(groups.LITERAL_GROUPS) == 12


@pytest.mark.parametrize("n_out, verdict, recovered", [(97, "loss", 97.0), (100, "equal", 100.0), (101, "surplus", 101.0)])
def test_reconcile(spark, n_out, verdict, recovered):
    nc = spark.createDataFrame([(0, i, 0) for i in range(100)], "file_idx int, evtid long, nc_id long")
    row = reconcile.reconcile(nc, spark.createDataFrame([("train",)] * n_out, "split string")).first()
    assert (row["verdict"], row["pct_recovered"]) == (verdict, recovered)


def test_names_by_length_then_name(spark):
    lines = spark.createDataFrame([('  <physvol name="bb">',), ('<physvol   name="a"/>',), ('<physvol name="ab">',), ('<physvol name="ab">',), ('x <physvol name="no">',)], "value string")
    assert [r["name"] for r in groups.ordered(groups.extract_names(lines)).collect()] == ["a", "ab", "bb"]


def test_idempotent_training_set(spark, tmp_path):
    from hitlake.plans.build import write_training_set

    rows = spark.createDataFrame([(0, 1, "train", 2.0), (1, 1, "train", 3.0)], "file_idx int, evtid long, split string, weight float")
    for part in (rows, rows.where("file_idx = 1")):
        write_training_set(part, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_report_and_readers(spark, tmp_path):
    from hitlake.sources import readers

    names = spark.createDataFrame([("b",), ("a",)], "name string")
    groups.write_report(names, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["unmatched names: 2", "a", "b"]
    (tmp_path / "d.json").write_text('{"x": 1,\n "": 2}')
    assert {r["name"]: r["id"] for r in readers.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {"x": 1, "": 2}
    (tmp_path / "v.json").write_text('[{"index": "7", "center": [1, 2, 3], "corners": [[1, 2, 3], [4, 5, 6]], "layer": "Pit"}]')
    row = targets.voxel_metadata(readers.read_voxels(spark, str(tmp_path / "v.json"))).first()
    assert (row["voxel_index"], row["is_pit"], row["corner_y"]) == ("7", 1.0, [2.0, 5.0])
    for run in ("run001", "run002"):
        (tmp_path / "sim" / run).mkdir(parents=True)
        (tmp_path / "sim" / run / "output_1").write_text("x")
        (tmp_path / "sim" / run / "other").write_text("x")
    found = readers.manifest(readers.discover(spark, str(tmp_path / "sim"), nested=True)).orderBy("file_rank").collect()
    assert [(r["run"], r["file_name"], r["file_rank"]) for r in found] == [("run001", "output_1", 0), ("run002", "output_1", 1)]


def test_grid_against_every_voxel(spark):
    """Random centres, some repeated; hits inside, far outside, and not finite."""
    import random

    rng = random.Random(3)
    spot = lambda r: [float(rng.randint(-r, r)) for _ in range(3)]
    centres = [spot(50) for _ in range(60)] + [spot(3) for _ in range(60)]
    centres += centres[:20]
    voxels = spark.createDataFrame([(i, f"v{i}", c, "top") for i, c in enumerate(centres)], VOXEL)
    hits = [(str(i), *spot(60)) for i in range(200)] + [("far", 9000.0, -9000.0, 1.0), ("nan", float("nan"), 0.0, 0.0), ("none", None, 0.0, 0.0)]
    df = spark.createDataFrame(hits, "photon_id string, x double, y double, z double")
    want = {}
    for name, x, y, z in hits:
        want[name] = "-1" if x is None or x != x else f"v{min(range(len(centres)), key=lambda i: (sum((a - b) ** 2 for a, b in zip((x, y, z), centres[i])), i))}"
    for cell in (None, 0.7, 500.0):
        assert {r["photon_id"]: r["voxel_index"] for r in nearest.nearest_grid(df, voxels, cell).collect()} == want
    assert {r["voxel_index"] for r in nearest.nearest_grid(df, voxels.limit(0)).collect()} == {"-1"}


def test_quantiles_by_rank(spark):
    import numpy as np

    from hitlake.operators import ranks

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=777), rng.integers(0, 4, 500).astype(float), np.array([3.0]), np.zeros(50)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
        assert ranks.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert ranks.quantiles(df.where("v is null"), "v", [0.5]) == [None]
    names = spark.createDataFrame([(f"p{i:03}",) for i in range(300)], "name string").repartition(7)
    assert [r["k"] for r in ranks.numbered(names, "name", "k").orderBy("name").collect()] == list(range(300))


def test_quantiles_of_several_columns_move_no_values(spark):
    import numpy as np

    from hitlake.operators import ranks

    rng = np.random.default_rng(4)
    wide = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), [1.7e308, -1.7e308, 5e-324]])
    columns = {"a": wide, "b": np.round(rng.normal(size=903), 1), "c": np.concatenate([[np.inf, -np.inf, -np.inf], rng.normal(size=900)]), "d.e": np.full(903, 7.0)}
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*columns.values())] + [(None, float("nan"), None, None)], "a double, b double, c double, `d.e` double").repartition(3)
    shares = [0.0, 0.003, 0.25, 0.5, 0.77, 1.0]
    got = ranks.quantiles_of(df, {c: shares for c in columns})
    for c, values in columns.items():
        ordered = np.sort(values)
        want = []
        for s in shares:
            low, part = int(s * 902), s * 902 - int(s * 902)
            high = min(902, low + 1)
            want.append(ordered[low] if ordered[low] == ordered[high] or not part else ordered[low] + (ordered[high] - ordered[low]) * part)
        assert got[c] == pytest.approx(want), c
    assert ranks.quantiles_of(df.limit(0), {"a": shares, "b": [0.5]}) == {"a": [None] * 6, "b": [None]}


def test_clustered_detector(spark, monkeypatch):
    """Most centres in spots a thousandth of the detector wide: lists stay short on every level, and results are those of every voxel."""
    import random

    rng = random.Random(8)
    centres = [[rng.uniform(-1000, 1000) for _ in range(3)] for _ in range(150)]
    for spot in ([10.0, 20.0, 30.0], [-400.0, 5.0, 600.0]):
        centres += [[c + rng.gauss(0, 0.4) for c in spot] for _ in range(700)]
    centres += centres[200:220]
    voxels = spark.createDataFrame([(i, f"v{i}", c, "top") for i, c in enumerate(centres)], VOXEL)
    hits = [(f"a{i}", *[rng.uniform(-1100, 1100) for _ in range(3)]) for i in range(60)] + [(f"b{i}", *[c + rng.gauss(0, 1.0) for c in (10.0, 20.0, 30.0)]) for i in range(60)]
    hits += [("nan", float("nan"), 0.0, 0.0), ("far", 1e9, -1e9, 3.0), ("none", None, 0.0, 1.0)]
    df = spark.createDataFrame(hits, "photon_id string, x double, y double, z double")
    points = nearest.centres(voxels)
    by_level = nearest.levels(points, nearest.fitted_cell(points)[1])
    assert len(by_level) > 2 and max(f.selectExpr("max(size(_near))").first()[0] for _, f in by_level) <= nearest.MOST_NEAR
    want = {r["photon_id"]: r["voxel_index"] for r in nearest.nearest_brute(df.where("photon_id <> 'nan' and x is not null"), voxels).collect()} | {"nan": "-1", "none": "-1"}
    assert {r["photon_id"]: r["voxel_index"] for r in nearest.nearest_grid(df, voxels).collect()} == want
    monkeypatch.setattr(nearest, "MOST_TREE", 0)
    near = df.where("abs(x) < 5000")
    assert {r["photon_id"]: r["voxel_index"] for r in nearest.nearest_grid(near, voxels).collect()}.items() <= want.items()
