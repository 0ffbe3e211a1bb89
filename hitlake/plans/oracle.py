"""DuckDB SQL for the registered queries, over the same views in SQL."""

from __future__ import annotations

from hitlake.operators.groups import LITERAL_GROUPS, rules
from hitlake.operators.stats import PERCENTILES, RANGES
from hitlake.sources.views import VOLUME_NAME, source_file

_K = "o_orderkey"
_GAMMA = ", ".join(
    f"{{'e': CAST((({_K} * {i}) % 9) * 100 - 100 AS DOUBLE), 'px': CAST((o_custkey + {i}) % 5 - 2 AS DOUBLE) / 2, 'py': CAST(({_K} + {i}) % 7 - 3 AS DOUBLE) / 3, 'pz': CAST(({_K} * {i}) % 11 - 5 AS DOUBLE) / 5}}" for i in range(1, 5)
)

#: The views every query may use; DuckDB evaluates only those it needs.
VIEWS = f"""WITH
cap AS (
  SELECT CAST({_K} // 1000 AS INT) AS file_idx, ({_K} % 1000) // 4 AS evtid, {_K} % 4 AS nc_id, d.row_ix,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 5.0::DOUBLE * d.row_ix AS nc_time,
    CAST(o_custkey % 80 - 40 AS DOUBLE) * 0.1::DOUBLE AS x, CAST({_K} % 90 - 45 AS DOUBLE) * 0.09::DOUBLE AS y, CAST({_K} % 89 AS DOUBLE) * 0.1::DOUBLE - 4.979::DOUBLE AS z,
    CAST({_K} % 7 - 1 AS INT) AS gamma_amount, o_totalprice / 10 - 500 AS gamma_total, [{_GAMMA}] AS gammas, o_orderpriority AS material,
    CASE WHEN {_K} % 23 = 0 THEN '' ELSE coalesce(c_mktsegment, '') END AS volume, {VOLUME_NAME.format(k=_K)} AS phys_volume, {_K} % 19 = 0 AS flag
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT 0 AS row_ix UNION ALL SELECT 1) d
  WHERE d.row_ix = 0 OR {_K} % 17 = 0),
nc AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY file_idx, evtid, nc_id ORDER BY row_ix DESC) = 1),
photon AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS photon_id, CAST(l_orderkey // 1000 AS INT) AS file_idx, (l_orderkey % 1000) // 4 AS evtid,
    CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE l_orderkey % 4 END AS nc_id, 1963 + l_linenumber AS det_uid,
    CAST((CAST(l_partkey % 100 AS DOUBLE) - 49.5::DOUBLE) * 0.09::DOUBLE AS REAL) AS x, CAST((CAST(l_suppkey % 100 AS DOUBLE) - 49.5::DOUBLE) * 0.09::DOUBLE AS REAL) AS y, CAST(l_quantity * 0.2::DOUBLE - 5.2::DOUBLE AS REAL) AS z,
    CAST(l_discount - 0.05::DOUBLE AS REAL) AS px, CAST(l_tax - 0.04::DOUBLE AS REAL) AS py, CAST((l_linenumber - 4) / 4.0::DOUBLE AS REAL) AS pz,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time
  FROM lineitem),
det AS (SELECT * FROM photon WHERE det_uid IN (1965, 1966, 1967, 1968)),
voxel AS (
  SELECT CAST(p_partkey AS INT) AS ord, CAST(p_partkey AS VARCHAR) AS index, CAST((p_partkey * 37 % 80 - 40) * 100 AS DOUBLE) AS cx, CAST((p_partkey * 53 % 80 - 40) * 100 AS DOUBLE) AS cy,
    CAST((p_partkey * 71 % 90) * 100 - 4979 AS DOUBLE) AS cz, CASE p_partkey % 5 WHEN 0 THEN 'Pit' WHEN 1 THEN 'bot' WHEN 2 THEN 'WALL' WHEN 3 THEN 'top' ELSE 'other' END AS layer
  FROM part),
centre AS (SELECT * FROM voxel QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY ord) = 1),
mm AS (SELECT * REPLACE (x * 1000::REAL AS x, y * 1000::REAL AS y, z * 1000::REAL AS z) FROM det),
outward AS (
  SELECT *, CASE WHEN CAST(z AS DOUBLE) <= -4979.0::DOUBLE THEN 'bot' WHEN CAST(z AS DOUBLE) >= 3919.0::DOUBLE THEN 'top' ELSE 'barrel' END AS region FROM mm
  WHERE CASE WHEN CAST(z AS DOUBLE) <= -4979.0::DOUBLE THEN pz <= 0 WHEN CAST(z AS DOUBLE) >= 3919.0::DOUBLE THEN pz >= 0 ELSE x * px + y * py >= 0 END),
near_hits AS (SELECT o.* FROM outward o JOIN nc USING (file_idx, evtid, nc_id) WHERE o.time BETWEEN nc.nc_time AND nc.nc_time + 200),
wide_hits AS (SELECT o.* FROM outward o JOIN nc USING (file_idx, evtid, nc_id) WHERE o.time BETWEEN nc.nc_time AND nc.nc_time + 1500),
near_best AS (
  SELECT photon_id, index AS voxel_index FROM near_hits h CROSS JOIN centre v
  QUALIFY row_number() OVER (PARTITION BY photon_id ORDER BY (h.x::DOUBLE - cx) * (h.x::DOUBLE - cx) + (h.y::DOUBLE - cy) * (h.y::DOUBLE - cy) + (h.z::DOUBLE - cz) * (h.z::DOUBLE - cz), ord) = 1),
wide_best AS (
  SELECT file_idx, evtid, nc_id, photon_id, index AS voxel_index, ord, layer FROM wide_hits h CROSS JOIN centre v
  QUALIFY row_number() OVER (PARTITION BY photon_id ORDER BY (h.x::DOUBLE - cx) * (h.x::DOUBLE - cx) + (h.y::DOUBLE - cy) * (h.y::DOUBLE - cy) + (h.z::DOUBLE - cz) * (h.z::DOUBLE - cz), ord) = 1),
vhits AS (SELECT file_idx, evtid, nc_id, voxel_index, CAST(count(*) AS INT) AS hits FROM wide_best GROUP BY ALL),
rhits AS (
  SELECT file_idx, evtid, nc_id, CAST(count(*) AS INT) AS total_hits, CAST(count(*) FILTER (lower(layer) = 'pit') AS INT) AS pit, CAST(count(*) FILTER (lower(layer) = 'bot') AS INT) AS bot,
    CAST(count(*) FILTER (lower(layer) = 'wall') AS INT) AS wall, CAST(count(*) FILTER (lower(layer) = 'top') AS INT) AS top, CAST(count(DISTINCT voxel_index) AS INT) AS voxels_hit FROM wide_best GROUP BY ALL),
full_hits AS (
  SELECT nc.*, coalesce(total_hits, 0) AS total_hits, coalesce(pit, 0) AS pit, coalesce(bot, 0) AS bot, coalesce(wall, 0) AS wall, coalesce(top, 0) AS top, coalesce(voxels_hit, 0) AS voxels_hit
  FROM nc LEFT JOIN rhits USING (file_idx, evtid, nc_id)),
mat_names AS (SELECT material AS name, row_number() OVER (ORDER BY material) AS rank FROM (SELECT DISTINCT material FROM cap)),
vol_names AS (SELECT volume AS name, row_number() OVER (ORDER BY volume) AS rank FROM (SELECT DISTINCT volume FROM cap)),
mat_dict AS (SELECT name, CAST(rank AS INT) AS id FROM mat_names),
vol_dict AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS INT) AS id FROM (SELECT DISTINCT CASE WHEN name = '' THEN 'noVolume' ELSE name END AS name FROM vol_names)),
ids AS (
  SELECT c.*, CAST((m.rank + file_idx) % 7 AS INT) AS mat_local, CAST((v.rank + file_idx) % 7 AS INT) AS vol_local, md.id AS mat_id, vd.id AS vol_id
  FROM cap c JOIN mat_names m ON m.name = c.material JOIN vol_names v ON v.name = c.volume JOIN mat_dict md ON md.name = c.material
  JOIN vol_dict vd ON vd.name = CASE WHEN c.volume = '' THEN 'noVolume' ELSE c.volume END),
ids_nc AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY file_idx, evtid, nc_id ORDER BY row_ix DESC) = 1),
xyz AS (SELECT *, CAST(x AS REAL) * 1000::REAL AS xm, CAST(y AS REAL) * 1000::REAL AS ym, CAST(z AS REAL) * 1000::REAL AS zm FROM ids),
evt AS (SELECT DISTINCT file_idx, evtid FROM cap),
splits AS (
  SELECT file_idx, evtid, CASE WHEN row_number() OVER (ORDER BY md5('42:' || file_idx || ':' || evtid), file_idx, evtid) <= floor((SELECT count(*) FROM evt) * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'validation' END AS split FROM evt),
per_key AS (SELECT file_idx, evtid, nc_id, count(*) AS n_photons FROM photon WHERE nc_id >= 0 GROUP BY ALL),
keys AS (SELECT DISTINCT file_idx, evtid, nc_id FROM cap),
yields AS (SELECT file_idx, evtid, nc_id, coalesce(n_photons, 0) AS n_photons FROM keys FULL OUTER JOIN per_key USING (file_idx, evtid, nc_id)),
fstats AS (
  SELECT file_idx, coalesce(n_photons, 0) AS n_photons, coalesce(n_orphaned, 0) AS n_orphaned, coalesce(n_with_photons, 0) AS n_with_photons, coalesce(n_zero, 0) AS n_zero, coalesce(n_captures, 0) AS n_captures,
    coalesce(n_photons, 0) - coalesce(n_orphaned, 0) AS n_valid,
    round(CASE WHEN n_photons > 0 THEN 100.0::DOUBLE * n_orphaned / n_photons ELSE 0 END, 6) AS pct_orphaned, round(CASE WHEN n_captures > 0 THEN 100.0::DOUBLE * n_zero / n_captures ELSE 0 END, 6) AS pct_zero
  FROM (SELECT file_idx, count(*) AS n_photons, count(*) FILTER (nc_id < 0) AS n_orphaned FROM photon GROUP BY 1)
  FULL OUTER JOIN (SELECT file_idx, count(*) FILTER (n_photons > 0) AS n_with_photons, count(*) FILTER (n_photons = 0) AS n_zero FROM yields GROUP BY 1) USING (file_idx)
  FULL OUTER JOIN (SELECT file_idx, count(*) AS n_captures FROM keys GROUP BY 1) USING (file_idx)),
det_key AS (SELECT file_idx, evtid, nc_id, count(*) AS n_photons FROM det WHERE nc_id >= 0 GROUP BY ALL),
ptable AS (
  SELECT x.* EXCLUDE (x, y, z), coalesce(n_photons, 0) AS n_photons, sqrt(xm::DOUBLE * xm::DOUBLE + ym::DOUBLE * ym::DOUBLE) AS r, zm::DOUBLE AS z_mm, gammas[1].e AS gamma1, gamma_total AS total
  FROM xyz x LEFT JOIN det_key USING (file_idx, evtid, nc_id)),
dts AS (SELECT d.time - nc.nc_time AS dt FROM det d JOIN nc USING (file_idx, evtid, nc_id)),
files AS (
  SELECT file_idx, source_file, CAST(dense_rank() OVER (ORDER BY source_file) - 1 AS INT) AS file_rank, split_part(source_file, '/', 3) AS file_name, split_part(source_file, '/', 2) AS run
  FROM (SELECT file_idx, {source_file('file_idx')} AS source_file FROM (SELECT DISTINCT file_idx FROM cap))),
sound AS (SELECT * FROM evt WHERE file_idx % 8 NOT IN (1, 2, 3)),
phys AS (SELECT DISTINCT phys_volume AS name FROM cap)
"""

_R = "round({0}, 6) + 0 AS {1}"
_GROUP = "CASE WHEN name IN (" + ", ".join(f"'{g}'" for g in LITERAL_GROUPS) + ") THEN name " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{g}'" for g, p in rules()) + " ELSE 'unmatched' END"
_MEAN = "CASE WHEN len([g FOR g IN gammas IF g.e > 0]) > 0 THEN list_sum([{0} FOR g IN gammas IF g.e > 0]) / len([g FOR g IN gammas IF g.e > 0]) ELSE 0 END"
_MEAN_R, _MEAN_Z = _MEAN.format("sqrt(g.px * g.px + g.py * g.py)"), _MEAN.format("g.pz")
_SLOTS = ", ".join(f"round(CAST(CASE WHEN gammas[{i}].e < 0 THEN 0 ELSE gammas[{i}].{f} END AS REAL)::DOUBLE, 6) + 0 AS {n.format(i)}" for i in range(1, 5) for f, n in (("e", "gammaE{}_keV"), ("px", "gammapx{}"), ("py", "gammapy{}"), ("pz", "gammapz{}")))


def _pct(n: str, d: str) -> str:
    return f"round(CASE WHEN {d} > 0 THEN 100.0::DOUBLE * ({n}) / ({d}) ELSE 0 END, 6) + 0"


def _edges(lo: str, hi: str, n: int) -> str:
    """(bin, lo, hi) of n even bins between two scalars."""
    return f"(SELECT CAST(i AS INT) AS bin, {lo} + ({hi} - {lo}) * i::DOUBLE / {n} AS lo, CASE WHEN i = {n - 1} THEN {hi} ELSE {lo} + ({hi} - {lo}) * (i + 1)::DOUBLE / {n} END AS hi, i = {n - 1} AS closed FROM range({n}) t(i))"


def _log_list(hi: str, n: int) -> str:
    """n edges from 1 to a column, evenly spaced in the exponent, the last exactly the column."""
    return f"list_concat([pow(10::DOUBLE, log10({hi}) * i::DOUBLE / {n - 1}) FOR i IN range({n - 1})], [{hi}])"


def _of_list(edges: str, hi: str = "0", lo: str = "0") -> str:
    """(bin, lo, hi) of a list of edges; the list may use the columns hi and lo, scalars of a subquery."""
    return f"(SELECT CAST(i AS INT) - 1 AS bin, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS closed FROM (SELECT unnest(range(1, len(e))) AS i, e FROM (SELECT {edges} AS e FROM (SELECT {hi} AS hi, {lo} AS lo))))"


def _hist(rows: str, value: str, edges: str, by: str = "") -> str:
    """Counts of every bin; rows is a relation."""
    inside = f"v.{value} >= e.lo AND (v.{value} < e.hi OR (e.closed AND v.{value} <= e.hi))"
    if not by:
        return f"SELECT bin, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, count(v.{value}) AS n FROM {edges} e LEFT JOIN {rows} v ON {inside} GROUP BY ALL"
    return f"SELECT g.{by}, bin, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, count(v.{value}) AS n FROM {edges} e CROSS JOIN (SELECT DISTINCT {by} FROM {rows}) g LEFT JOIN {rows} v ON v.{by} = g.{by} AND {inside} GROUP BY ALL"


def _hist2(rows: str, x: str, xlo: str, xhi: str, y: str, ylo: str, yhi: str, n: int) -> str:
    at = lambda c, lo, hi: f"CAST(least(floor(({c}::DOUBLE - {lo}) * {n} / ({hi} - {lo})), {n - 1}) AS INT)"
    return f"SELECT {at(x, xlo, xhi)} AS bin_x, {at(y, ylo, yhi)} AS bin_y, count(*) AS n FROM {rows} WHERE {x} BETWEEN {xlo} AND {xhi} AND {y} BETWEEN {ylo} AND {yhi} GROUP BY ALL"


_MAX = "(SELECT greatest(max(n_photons), 1.000001)::DOUBLE FROM {0})"
_DLO, _DHI = "(SELECT min(dt) FROM dts)", "(SELECT max(dt) FROM dts)"
_TOTALS = "SELECT nc.file_idx, nc.evtid, nc.nc_id, nc.phys_volume AS name, coalesce(h.total_hits, 0) AS total_hits, coalesce(h.voxels_hit, 0) AS voxels_hit FROM nc LEFT JOIN (SELECT file_idx, evtid, nc_id, CAST(sum(hits) AS BIGINT) AS total_hits, count(*) AS voxels_hit FROM vhits GROUP BY ALL) h USING (file_idx, evtid, nc_id)"
_TRAIN = "(SELECT f.* EXCLUDE (mat_id, vol_id), mat_id, vol_id, coalesce(split, 'train') AS split FROM (SELECT i.file_idx, i.evtid, i.nc_id, i.mat_id, i.vol_id, i.x, i.y, i.z, h.total_hits, h.pit, h.bot, h.wall, h.top, h.voxels_hit FROM ids_nc i JOIN full_hits h USING (file_idx, evtid, nc_id)) f LEFT JOIN splits USING (file_idx, evtid))"
_R_MM = "sqrt((CAST(x AS REAL) * 1000::REAL)::DOUBLE * (CAST(x AS REAL) * 1000::REAL)::DOUBLE + (CAST(y AS REAL) * 1000::REAL)::DOUBLE * (CAST(y AS REAL) * 1000::REAL)::DOUBLE)"
_PHI = "atan2((CAST(y AS REAL) * 1000::REAL)::DOUBLE, (CAST(x AS REAL) * 1000::REAL)::DOUBLE)"
_KEY = "file_idx, evtid, nc_id"
_BY_PATH = "(SELECT file_idx, evtid, CASE WHEN row_number() OVER (ORDER BY md5('42:' || source_file || ':' || evtid), source_file, evtid) <= floor((SELECT count(*) FROM evt) * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'validation' END AS split FROM evt JOIN files USING (file_idx))"

_BODIES = {
    "flagship": f"SELECT {_KEY}, total_hits, pit, bot, wall, top, round({_R_MM}, 6) + 0 AS r_mm, round({_PHI}, 6) + 0 AS phi_rad FROM full_hits",
    "raw_nc_scan": f"SELECT {_KEY}, row_ix, nc_time, round(xm::DOUBLE, 6) + 0 AS x_mm, round(ym::DOUBLE, 6) + 0 AS y_mm, round(zm::DOUBLE, 6) + 0 AS z_mm, gammas[1].e AS e1, flag FROM xyz",
    "raw_optical_scan": f"SELECT photon_id, {_KEY}, det_uid, round((x * 1000::REAL)::DOUBLE, 6) + 0 AS x_mm, round((y * 1000::REAL)::DOUBLE, 6) + 0 AS y_mm, round((z * 1000::REAL)::DOUBLE, 6) + 0 AS z_mm, round(px::DOUBLE, 6) + 0 AS px, round(py::DOUBLE, 6) + 0 AS py, round(pz::DOUBLE, 6) + 0 AS pz, time FROM photon",
    "detector_filter": "SELECT photon_id, det_uid FROM det",
    "dedup_last_wins": f"SELECT {_KEY}, row_ix, nc_time FROM nc",
    "time_window_join": f"SELECT photon_id, {_KEY}, time FROM det JOIN nc USING ({_KEY}) WHERE time BETWEEN nc_time AND nc_time + 200",
    "orphan_unmatched": f"SELECT file_idx, count(*) AS n_orphans FROM det ANTI JOIN nc USING ({_KEY}) GROUP BY 1",
    "orphan_sentinel": "SELECT file_idx, count(*) AS n_orphans FROM photon WHERE nc_id < 0 GROUP BY 1",
    "direction_filter": "SELECT photon_id, region FROM outward",
    "nearest_voxel": "SELECT * FROM near_best",
    "nearest_voxel_grid": "SELECT * FROM near_best",
    "voxel_hits": "SELECT * FROM vhits",
    "region_hits": "SELECT * FROM rhits",
    "dense_target": f"SELECT {_KEY}, (SELECT CAST(count(*) AS INT) FROM voxel) AS n_voxels, CAST(sum(hits) AS BIGINT) AS total, string_agg(pos || ':' || hits, ',' ORDER BY pos) AS nonzero FROM vhits JOIN (SELECT index AS voxel_index, row_number() OVER (ORDER BY ord) - 1 AS pos FROM voxel) USING (voxel_index) GROUP BY ALL",
    "voxel_metadata": "SELECT index AS voxel_index, " + ", ".join(f"CAST(lower(layer) = '{n}' AS INT)::DOUBLE AS is_{n}" for n in ("pit", "bot", "wall", "top")) + ", round(CAST(sqrt(cx * cx + cy * cy) AS REAL)::DOUBLE, 6) + 0 AS r, round(CAST(atan2(cy, cx) AS REAL)::DOUBLE, 6) + 0 AS phi, round(CAST(cz AS REAL)::DOUBLE, 6) + 0 AS z FROM voxel",
    "dimension_tables": "SELECT 'material' AS dimension, name AS key, id::DOUBLE AS value FROM mat_dict UNION ALL SELECT 'volume', name, id::DOUBLE FROM vol_dict UNION ALL SELECT 'center_' || i, index, [cx, cy, cz][i + 1] FROM voxel CROSS JOIN range(3) t(i)",
    "nc_features": f"""SELECT {_KEY}, round(xm::DOUBLE, 3) + 0 AS "xNC_mm", round(ym::DOUBLE, 3) + 0 AS "yNC_mm", round(zm::DOUBLE, 3) + 0 AS "zNC_mm", mat_id::DOUBLE AS "matID", vol_id::DOUBLE AS "volID",
      greatest(gamma_amount, 0)::DOUBLE AS n_gamma, round(CAST(greatest(gamma_total, 0) AS REAL)::DOUBLE, 3) + 0 AS "E_gamma_tot_keV", round(CAST(r AS REAL)::DOUBLE, 3) + 0 AS "r_NC_mm", round(CAST(atan2(ym::DOUBLE, xm::DOUBLE) AS REAL)::DOUBLE, 6) + 0 AS "phi_NC_rad",
      round(CAST(4300.0::DOUBLE - r AS REAL)::DOUBLE, 3) + 0 AS dist_to_wall_mm, round(CAST(zm::DOUBLE + 4979.0::DOUBLE AS REAL)::DOUBLE, 3) + 0 AS dist_to_bot_mm, round(CAST(3919.0::DOUBLE - zm::DOUBLE AS REAL)::DOUBLE, 3) + 0 AS dist_to_top_mm,
      round(CAST({_MEAN_R} AS REAL)::DOUBLE, 6) + 0 AS p_mean_r, round(CAST({_MEAN_Z} AS REAL)::DOUBLE, 6) + 0 AS p_mean_z
      FROM (SELECT *, sqrt(xm::DOUBLE * xm::DOUBLE + ym::DOUBLE * ym::DOUBLE) AS r FROM xyz QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY row_ix DESC) = 1)""",
    "gamma_slots": f"SELECT {_KEY}, {_SLOTS} FROM nc",
    "gamma_direction": f"SELECT {_KEY}, round({_MEAN_R}, 6) + 0 AS p_mean_r, round({_MEAN_Z}, 6) + 0 AS p_mean_z FROM nc",
    "dictionary_build": """SELECT name, CAST(CASE WHEN known THEN row_number() OVER (PARTITION BY known ORDER BY name) ELSE (SELECT count(DISTINCT CASE WHEN volume = '' THEN 'noVolume' ELSE volume END) FROM cap WHERE file_idx = 0) + row_number() OVER (PARTITION BY known ORDER BY name) END AS INT) AS id
      FROM (SELECT CASE WHEN volume = '' THEN 'noVolume' ELSE volume END AS name, bool_or(file_idx = 0) AS known FROM cap GROUP BY 1)""",
    "dictionary_remap": "SELECT file_idx, mat_local, mat_id, vol_local, vol_id, count(*) AS n FROM ids GROUP BY ALL",
    "group_split": "SELECT * FROM splits",
    "split_reuse": f"""SELECT nc.file_idx, coalesce(s.split, 'train') AS split, count(*) AS n FROM nc LEFT JOIN (SELECT file_idx, evtid, CASE WHEN row_number() OVER (ORDER BY md5('42:' || file_idx || ':' || evtid), file_idx, evtid) <= floor((SELECT count(*) FROM evt WHERE file_idx % 7 <> 0) * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'validation' END AS split FROM evt WHERE file_idx % 7 <> 0) s USING (file_idx, evtid) GROUP BY ALL""",
    "event_weight": "SELECT count(*) AS n_distinct, CASE WHEN count(*) > 0 THEN round(1.0::DOUBLE / count(*), 12) ELSE 1 END AS weight FROM keys",
    "event_weight_sampled": "SELECT count(*) AS n_distinct, CASE WHEN count(*) > 0 THEN round(1.0::DOUBLE / (count(*) * greatest((SELECT count(DISTINCT file_idx) FROM cap) / 5.0::DOUBLE, 1)), 12) ELSE 1 END AS weight FROM keys WHERE file_idx < 5",
    "build_training_set": f"SELECT {_KEY}, split, total_hits, pit, bot, wall, top, voxels_hit, mat_id, vol_id, round(CAST({_R_MM} AS REAL)::DOUBLE, 3) + 0 AS \"r_NC_mm\", round(CAST(1.0::DOUBLE / (SELECT count(*) FROM keys) AS REAL)::DOUBLE, 9) AS weight FROM {_TRAIN}",
    "completeness_check": f"SELECT file_idx, count(*) AS n_in, count(*) AS n_out, true AS complete FROM nc GROUP BY 1",
    "distinct_captures": "SELECT file_idx, count(*) AS n_distinct FROM keys GROUP BY 1",
    "reconcile_counts": f"""SELECT n_in, n_out, n_train, n_validation, n_in - n_out AS difference, {_pct('n_out', 'n_in')} AS pct_recovered, {_pct('n_in - n_out', 'n_in')} AS pct_lost, {_pct('n_train', 'n_out')} AS pct_train, {_pct('n_validation', 'n_out')} AS pct_validation,
      CASE WHEN n_in = n_out THEN 'equal' WHEN n_out < n_in THEN 'loss' ELSE 'surplus' END AS verdict
      FROM (SELECT count(*) AS n_in FROM keys), (SELECT count(*) AS n_out, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation FROM nc JOIN splits USING (file_idx, evtid) WHERE file_idx % 29 <> 1)""",
    "processing_summary": f"""SELECT file_idx, count(*) FILTER (total_hits > 0) AS n_with, count(*) FILTER (total_hits = 0) AS n_without, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, any_value(n_orphans) AS n_orphans
      FROM full_hits JOIN splits USING (file_idx, evtid) LEFT JOIN (SELECT file_idx, count(*) AS n_orphans FROM det ANTI JOIN nc USING ({_KEY}) GROUP BY 1) USING (file_idx) GROUP BY 1""",
    "file_manifest": "SELECT source_file, file_idx, file_rank, file_name, run FROM files WHERE run <= 'run008'",
    "file_sample": "SELECT source_file FROM files ORDER BY md5('42:' || source_file), source_file LIMIT 10",
    "remaining_files": "SELECT source_file, file_idx FROM files WHERE file_idx % 3 <> 0",
    "file_quarantine": """SELECT file_idx, 'unmapped ' || string_agg(DISTINCT missing, ',' ORDER BY missing) AS reason, count(*) AS n_rows FROM (
      SELECT file_idx, concat_ws(',', CASE WHEN file_idx % 5 = 0 AND mat_local = 3 THEN 'mat_id' END, CASE WHEN file_idx % 6 = 0 AND vol_local = 4 THEN 'vol_id' END) AS missing FROM ids) WHERE missing <> '' GROUP BY 1""",
    "file_photon_stats": "SELECT * FROM fstats",
    "photon_yield_summary": f"""SELECT t.*, d.*, {_pct('t.n_orphaned', 't.n_photons')} AS pct_orphaned, {_pct('t.n_zero', 't.n_captures')} AS pct_zero FROM
      (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_photons', 'n_orphaned', 'n_valid', 'n_captures', 'n_with_photons', 'n_zero'))} FROM fstats) t,
      (SELECT round(avg(n_photons), 6) AS mean, round(median(n_photons), 6) AS median, round(stddev_pop(n_photons), 6) AS std, min(n_photons) AS min, max(n_photons) AS max, round(quantile_cont(n_photons, 0.25), 6) AS q25, round(quantile_cont(n_photons, 0.75), 6) AS q75,
        round(median(n_photons) FILTER (n_photons > 0), 6) AS median_positive, round(median(n_photons) FILTER (n_photons BETWEEN 1 AND 100), 6) AS median_1_100 FROM yields) d""",
    "top_orphan_files": "SELECT file_idx, n_photons, n_orphaned, pct_orphaned FROM fstats ORDER BY CASE WHEN n_photons > 0 THEN 100.0::DOUBLE * n_orphaned / n_photons ELSE 0 END DESC, file_idx LIMIT 10",
    "photon_yield_distribution": "SELECT * FROM yields",
    "zero_photon_captures": f"SELECT * FROM keys ANTI JOIN per_key USING ({_KEY})",
    "nc_photon_table": f"SELECT {_KEY}, row_ix, n_photons, round(r, 6) + 0 AS r, round(z_mm, 6) + 0 AS z_mm, gamma1, round(total, 6) + 0 AS total, mat_id, flag FROM ptable",
    "dt_summary": "SELECT count(*) AS n, round(avg(dt), 6) + 0 AS mean, round(median(dt), 6) + 0 AS median, round(stddev_pop(dt), 6) + 0 AS std, min(dt) AS min, max(dt) AS max, round(quantile_cont(dt, 0.25), 6) + 0 AS q25, round(quantile_cont(dt, 0.75), 6) + 0 AS q75 FROM dts",
    "dt_percentiles": " UNION ALL ".join(f"SELECT {p} AS percentile, round(quantile_cont(dt, {p / 100}), 6) + 0 AS value FROM dts" for p in PERCENTILES),
    "dt_window_counts": " UNION ALL ".join(f"SELECT {lo} AS lo, {hi} AS hi, count(*) FILTER (dt BETWEEN {lo} AND {hi}) AS n, {_pct(f'count(*) FILTER (dt BETWEEN {lo} AND {hi})', 'count(*)')} AS pct FROM dts" for lo, hi in RANGES),
    "material_yield": "SELECT *, CAST(row_number() OVER (ORDER BY n_photons::DOUBLE / n_captures DESC, material) AS INT) AS rank FROM (SELECT CASE WHEN d.name = '5-LOW' THEN 'Unknown_' || mat_id ELSE d.name END AS material, count(*) AS n_captures, CAST(sum(n_photons) AS BIGINT) AS n_photons, round(sum(n_photons)::DOUBLE / count(*), 6) AS photons_per_capture FROM ptable JOIN mat_dict d ON d.id = mat_id GROUP BY d.name, mat_id)",
    "flag_comparison": f"SELECT count(*) FILTER (flag) AS n_flagged, count(*) AS n_all, round(avg(n_photons) FILTER (flag), 6) AS mean_flagged, round(avg(n_photons) FILTER (NOT flag), 6) AS mean_other, round(median(n_photons) FILTER (flag), 6) AS median_flagged, round(median(n_photons) FILTER (NOT flag), 6) AS median_other, {_pct('count(*) FILTER (flag)', 'count(*)')} AS pct_flagged, round(avg(n_photons) FILTER (flag) / nullif(avg(n_photons) FILTER (NOT flag), 0), 6) AS mean_ratio FROM ptable",
    "nc_range_summary": "SELECT " + ", ".join(f"round({f}({c}), 6) + 0 AS {c}_{f}" for c in ("r", "z_mm", "gamma1", "total") for f in ("min", "max", "median")) + " FROM ptable",
    "group_histogram": "SELECT h.*, round(n::DOUBLE / events, 6) AS per_event FROM (" + _hist("ptable", "n_photons", _edges("0::DOUBLE", "(SELECT greatest(max(n_photons), 1)::DOUBLE FROM ptable)", 50), "volume") + ") h JOIN (SELECT volume, count(*) AS events FROM ptable GROUP BY 1) USING (volume)",
    "hist_log_zero": _hist("yields", "n_photons", _of_list(f"list_concat([0::DOUBLE, 0.5::DOUBLE], {_log_list('hi', 29)})", _MAX.format("yields"))),
    "hist_small_counts": _hist("(SELECT * FROM yields WHERE n_photons <= 100)", "n_photons", _of_list("list_concat([-0.5::DOUBLE, 0.5::DOUBLE], [i::DOUBLE FOR i IN range(1, 102, 2)])")),
    "hist_file_percent": " UNION ALL BY NAME ".join(f"(SELECT *, '{c}' AS metric FROM (" + _hist("fstats", c, _edges(f"(SELECT min({c}) FROM fstats)", f"(SELECT CASE WHEN max({c}) > min({c}) THEN max({c}) ELSE min({c}) + 1 END FROM fstats)", 30)) + "))" for c in ("pct_orphaned", "pct_zero")),
    "hist_dt_symlog": _hist("dts", "dt", _of_list(f"list_concat(list_concat(CASE WHEN lo < -1 THEN [-x FOR x IN list_reverse({_log_list('(-lo)', 50)})] ELSE [-1.0::DOUBLE] END, [0::DOUBLE]), CASE WHEN hi > 1 THEN {_log_list('hi', 50)} ELSE [1.0::DOUBLE] END)", _DHI, _DLO)),
    "hist_dt_zoom": _hist("(SELECT * FROM dts WHERE dt BETWEEN -50 AND 500)", "dt", _edges("(-50)::DOUBLE", "500::DOUBLE", 99)),
    "hist_flag_log": _hist("ptable", "n_photons", _of_list(_log_list("hi", 50), _MAX.format("ptable")), "flag"),
    "hist2d_position": _hist2("ptable", "r", "0::DOUBLE", "6000::DOUBLE", "z_mm", "(-5000)::DOUBLE", "4000::DOUBLE", 99),
    "hist2d_energy_photons": _hist2("(SELECT * FROM ptable WHERE total > 0)", "total", "0::DOUBLE", "(SELECT max(total) FROM ptable WHERE total > 0)", "n_photons", "0::DOUBLE", "(SELECT greatest(quantile_cont(n_photons, 0.99), 1)::DOUBLE FROM ptable WHERE total > 0)", 59),
    "regex_groups": f"SELECT name, {_GROUP} AS group_name FROM phys",
    "unmatched_names": f"SELECT name FROM phys WHERE ({_GROUP}) = 'unmatched'",
    "event_hit_totals": f"SELECT * EXCLUDE (name) FROM ({_TOTALS})",
    "group_spectrum_stats": f"SELECT {_GROUP} AS group_name, count(*) AS n_events, round(avg(total_hits), 6) AS mean_hits, round(avg(voxels_hit), 6) AS mean_voxels, round(median(total_hits), 6) AS median_hits, round(median(voxels_hit), 6) AS median_voxels FROM ({_TOTALS}) GROUP BY 1",
    "extract_names": """SELECT DISTINCT name, CAST(length(name) AS INT) AS n_chars FROM (SELECT unnest(regexp_extract_all(line, '<a[^>]* href="([^"]+)"', 1)) AS name FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages)) WHERE name <> ''""",
    "incremental_build": "SELECT coalesce(split, 'train') AS split, count(*) AS n FROM nc LEFT JOIN splits USING (file_idx, evtid) GROUP BY 1",
    "written_training_set": f"SELECT CAST(file_rank AS INT) AS file_idx, evtid, nc_id, p.split, total_hits, pit, bot, wall, top, voxels_hit, total_hits AS map_hits, mat_id, vol_id, round(CAST(1.0::DOUBLE / (SELECT count(*) FROM keys) AS REAL)::DOUBLE, 9) AS weight FROM {_TRAIN} JOIN files USING (file_idx) JOIN {_BY_PATH} p USING (file_idx, evtid)",
    "written_targets": "SELECT CAST(any_value(file_rank) AS INT) AS file_idx, evtid, nc_id, (SELECT CAST(count(*) AS INT) FROM voxel) AS n_voxels, CAST(sum(hits) AS INT) AS total, CAST(arg_min(pos, (-hits, pos)) AS INT) AS most_hit FROM vhits JOIN files f USING (file_idx) JOIN (SELECT index AS voxel_index, row_number() OVER (ORDER BY ord) - 1 AS pos FROM voxel) USING (voxel_index) GROUP BY vhits.file_idx, evtid, nc_id",
    "full_targets": """SELECT file_rank AS file_idx, evtid, nc_id, (SELECT CAST(count(*) AS INT) FROM voxel) AS n_voxels, CAST(coalesce(sum(hits), 0) AS INT) AS total, CAST(count(hits) AS INT) AS n_hit, CAST(coalesce(min(pos), -1) AS INT) AS first_hit, CAST(coalesce(max(pos), -1) AS INT) AS last_hit
      FROM nc JOIN files USING (file_idx) LEFT JOIN (SELECT * FROM vhits JOIN (SELECT index AS voxel_index, row_number() OVER (ORDER BY ord) - 1 AS pos FROM voxel) USING (voxel_index)) USING (file_idx, evtid, nc_id) GROUP BY ALL""",
    "damaged_files": f"""SELECT source_file, CASE WHEN b THEN 'failed' ELSE 'completed' END AS status, CASE WHEN NOT b THEN '' WHEN file_idx % 8 = 1 THEN 'photons' WHEN file_idx % 8 = 2 THEN 'materials' ELSE 'captures' END AS blamed,
        CASE WHEN b THEN 0 ELSE n_train END AS rows_train, CASE WHEN b THEN 0 ELSE n - n_train END AS rows_validation, CASE WHEN b THEN 0 ELSE n END AS n_rows, CASE WHEN b THEN 0 ELSE hits END AS n_hits
      FROM (SELECT source_file, file_idx, any_value(file_idx % 8 IN (1, 2, 3)) AS b, count(*) AS n, count(*) FILTER (coalesce(p.split, 'train') = 'train') AS n_train, CAST(sum(total_hits) AS BIGINT) AS hits
        FROM full_hits JOIN files USING (file_idx) LEFT JOIN {_BY_PATH.replace("FROM evt JOIN files", "FROM sound JOIN files").replace("FROM evt)", "FROM sound)")} p USING (file_idx, evtid) GROUP BY 1, 2)""",
    "grown_counts": "SELECT n AS n_in, n AS n_out, 'equal' AS verdict, round(CAST(1.0::DOUBLE / n AS REAL)::DOUBLE, 9) AS weight, hits AS n_hits, files AS n_files FROM (SELECT count(*) AS n, CAST(sum(total_hits) AS BIGINT) AS hits, count(DISTINCT file_idx) AS files FROM full_hits)",
    "file_inventory": "SELECT CASE WHEN file_idx % 8 < 4 THEN CAST(file_idx % 8 AS VARCHAR) ELSE '' END AS run, 'ok' AS state, file_idx % 8 >= 4 AS is_new, count(*) AS n_read, count(DISTINCT file_idx) AS n_files FROM cap GROUP BY ALL",
    "dictionary_growth": """SELECT name, CAST(row_number() OVER (ORDER BY step, name) AS INT) AS id FROM (SELECT phys_volume AS name, min(CASE WHEN file_idx < 1 THEN 0 WHEN file_idx < 3 THEN 1 ELSE 2 END) AS step FROM cap GROUP BY 1)""",
    "ordered_names": "SELECT name, CAST(length(name) AS INT) AS n_chars, row_number() OVER (ORDER BY length(name), name) - 1 AS position FROM phys",
    "written_counts": f"""SELECT n AS n_in, n AS n_out, n_train, n - n_train AS n_validation, 0::BIGINT AS difference, 100.0::DOUBLE AS pct_recovered, 0.0::DOUBLE AS pct_lost, {_pct('n_train', 'n')} AS pct_train, {_pct('n - n_train', 'n')} AS pct_validation, 'equal' AS verdict
      FROM (SELECT count(*) AS n, count(*) FILTER (p.split = 'train') AS n_train FROM nc JOIN {_BY_PATH} p USING (file_idx, evtid))""",
    "written_spectra": f"SELECT CASE WHEN volume = '' THEN 'noVolume' ELSE 'unmatched' END AS group_name, count(*) AS n_events, round(avg(total_hits), 6) AS mean_hits, round(avg(voxels_hit), 6) AS mean_voxels, round(median(total_hits), 6) AS median_hits, round(median(voxels_hit), 6) AS median_voxels FROM full_hits GROUP BY 1",
    "written_dimensions": """SELECT 'material_map' AS dimension, name AS key, id::DOUBLE AS value FROM mat_dict UNION ALL SELECT 'volume_map', name, id::DOUBLE FROM vol_dict UNION ALL SELECT 'voxel_metadata', index, cx - 1 FROM voxel
      UNION ALL SELECT 'geometry', unnest(['radius', 'height', 'cut_bottom', 'cut_top', 'lift', 'primaries']), unnest([4300.0::DOUBLE, 8900, -4979, 3919, 2, 1000])""",
    "run_record": f"""SELECT source_file, 'completed' AS status, count(*) FILTER (p.split = 'train') AS rows_train, count(*) FILTER (p.split = 'validation') AS rows_validation, '' AS reason FROM nc JOIN files USING (file_idx) JOIN {_BY_PATH} p USING (file_idx, evtid) GROUP BY 1
      UNION ALL SELECT 'damaged', 'failed', 0, 0, 'unreadable'""",
    "reset_build": f"SELECT p.split, count(*) AS n, CAST(sum(total_hits) AS BIGINT) AS hits FROM full_hits JOIN {_BY_PATH} p USING (file_idx, evtid) GROUP BY 1",
    "missing_captures": "SELECT f.file_idx, coalesce(n, 0) AS n_distinct, n IS NULL AS missing FROM (SELECT DISTINCT file_idx FROM photon) f LEFT JOIN (SELECT file_idx, count(*) AS n FROM keys WHERE file_idx % 5 <> 0 GROUP BY 1) USING (file_idx)",
    "stale_split": "SELECT file_idx, split, count(*) AS n FROM splits WHERE file_idx % 7 = 0 GROUP BY ALL",
    "geometry_names": "SELECT name, CAST(length(name) AS INT) AS n_chars FROM phys WHERE name <> ''",
    "unmatched_report": f"SELECT 'unmatched names: ' || count(*) AS value FROM phys WHERE ({_GROUP}) = 'unmatched' UNION ALL SELECT name FROM phys WHERE ({_GROUP}) = 'unmatched'",
}
_BODIES["dictionary_file"] = _BODIES["dictionary_build"]
_BODIES["bucketed_window_join"], _BODIES["json_report"] = _BODIES["time_window_join"], _BODIES["photon_yield_summary"]
_BODIES["resumed_build"] = _BODIES["written_training_set"]

ORACLE_SQL: dict[str, str] = {name: VIEWS + body for name, body in _BODIES.items()}
