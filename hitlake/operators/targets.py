"""Hit targets per capture: voxel and region counts, dense vectors, features, completeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.functions import geometry as geo
from hitlake.schema import KEY, LAYERS, PHI, Geometry


def voxel_hits(assigned: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hits per (capture, voxel): partial and final hash aggregate."""
    return assigned.groupBy(*keys, "voxel_index").agg(F.count("*").cast("int").alias("hits"))


def region_hits(hits: DataFrame, voxels: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Hits per (capture, region); layers are compared in lower case, others count in the total only.

    Of voxels with one index the first in the list names the layer.
    """
    layer = voxels.groupBy(F.col("index").alias("voxel_index")).agg(F.min_by(F.lower("layer"), "ord").alias("_layer"))
    joined = hits.join(layer, "voxel_index", "left")
    regions = [F.coalesce(F.sum(F.when(F.col("_layer") == name, F.col("hits"))), F.lit(0)).cast("int").alias(name) for name in LAYERS]
    by_voxel = F.map_from_entries(F.sort_array(F.collect_list(F.struct("voxel_index", "hits")))).alias("voxel_hits")  # bounded by the voxels
    return joined.groupBy(*keys).agg(F.sum("hits").cast("int").alias("total_hits"), *regions, F.count("*").cast("int").alias("voxels_hit"), by_voxel)


def dense_target(hits: DataFrame, voxels: DataFrame, keys: tuple[str, ...] = KEY, listed: bool = False) -> DataFrame:
    """One array of counts per capture, in voxel order, 0 where a voxel was not hit.

    The hits of a capture are put together as a map and scattered by `dense_rows`. The captures are few bytes but their
    arrays are not, so they are dealt over a fixed number of tasks and not left in the few that adaptive execution makes.
    """
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = hits.join(voxels.select(F.col("index").alias("voxel_index")).distinct(), "voxel_index", "left_semi")
    by_voxel = F.map_from_entries(F.collect_list(F.struct("voxel_index", "hits"))).alias("voxel_hits")  # bounded by the voxels
    return dense_rows(known.repartition(tasks, *keys).groupBy(*keys).agg(by_voxel), voxels, keys, listed)


LISTED = "n_voxels int, hit array<struct<at:int,hits:int>>"
CELLS = 1 << 21  # counts (captures x voxels) that a task writes at once


def dense_rows(rows: DataFrame, voxels: DataFrame, keys: tuple[str, ...] = KEY, listed: bool = False) -> DataFrame:
    """One array of counts per row in voxel order from its map `voxel_hits`, all zeros for an empty or null map.

    Nothing is shuffled: the places of the voxels, one entry each, are sent to the tasks, which scatter the counts into
    blocks of zeros. Voxels that are not in the list (-1) add nothing. With `listed` the result is that of `sparse_rows`,
    taken from the maps: the work grows with the hits and not with captures times voxels.
    """
    place = voxels.groupBy("index").agg(F.min("ord").alias("_ord")).orderBy("_ord").select("index").toArrow().column("index").combine_chunks()  # a detector description
    size = len(place)
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, CELLS // max(1, size))
        for batch, row, at, hits in _placed(batches, shared.value, len(keys), per):
            n = batch.num_rows
            counts = np.zeros(n * size, np.int32)
            counts[row * size + at] = hits
            target = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], target], names=[*keys, "target"])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, at, hits in _placed(batches, shared.value, len(keys)):
            order = np.lexsort((at, row))
            order = order[hits[order] != 0]
            yield _listed(batch, keys, np.full(batch.num_rows, size), row[order], at[order], hits[order])

    wanted = rows.select(*keys, "voxel_hits")
    if listed:
        return wanted.mapInArrow(listing, _named(rows, keys, LISTED))
    return wanted.mapInArrow(scatter, _named(rows, keys, "target array<int>"))


def _placed(batches: Iterator[pa.RecordBatch], place: pa.Array, column: int, per: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches, of `per` rows at most, with (row, place of the voxel, hits) of all entries of their maps whose voxel is listed.

    A task looks a name up in the whole list once, not once a batch.
    """
    seen, at_seen = place.slice(0, 0), np.empty(0, np.int64)
    for whole in batches:
        for lo in range(0, whole.num_rows, per or max(1, whole.num_rows)):
            batch = whole.slice(lo, per)
            maps = batch.column(column)
            offsets = maps.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            names = maps.keys.slice(offsets[0], len(row))
            distinct = names.unique()
            new = distinct.filter(pc.is_null(pc.index_in(distinct, value_set=seen)))
            if len(new):
                which = pc.index_in(place, value_set=new)  # hashes the few names, not the whole list
                listed, at_new = np.flatnonzero(which.is_valid()), np.full(len(new), -1)
                at_new[which.drop_null().to_numpy()] = listed
                at_seen = np.concatenate([at_seen, at_new])
                seen = pa.concat_arrays([seen, new])
            at = at_seen[pc.index_in(names, value_set=seen).to_numpy()]
            hits = maps.items.slice(offsets[0], len(row)).to_numpy(zero_copy_only=False)
            yield batch, row[at >= 0], at[at >= 0], hits[at >= 0]


def _listed(batch: pa.RecordBatch, keys: tuple[str, ...], sizes: np.ndarray, row: np.ndarray, at: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    """The keys of a batch with the length of each target and its entries, which come by row and place."""
    cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(hits.astype(np.int32))], names=["at", "hits"])
    hit = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes.astype(np.int32)), hit], names=[*keys, "n_voxels", "hit"])


def _gathered(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        target = batch.column(len(keys))
        offsets = target.offsets.to_numpy()
        counts = target.values.to_numpy()[offsets[0] : offsets[-1]]
        where = np.flatnonzero(counts)
        begins = offsets - offsets[0]
        row = np.searchsorted(begins, where, side="right") - 1
        yield _listed(batch, keys, np.diff(offsets), row, where - begins[row], counts[where])


def _named(rows: DataFrame, keys: tuple[str, ...], values: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + values


def sparse_rows(dense: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, n_voxels, hit) of dense targets: `hit` lists the counts that are not 0 as (at, hits), in voxel order."""
    return dense.select(*keys, "target").mapInArrow(lambda batches: _gathered(batches, keys), _named(dense, keys, LISTED))


def features(captures: DataFrame, scale: float = 1000.0, g: Geometry = Geometry(), material: str = "mat_id", volume: str = "vol_id", kept: tuple[str, ...] = ()) -> DataFrame:
    """The key and the 30 feature columns, single precision, in the fixed order; then the columns of `kept` as they are."""
    nc = captures.withColumns({c: geo.mm(F.col(c), scale) for c in "xyz"}).withColumn("gammas", geo.gamma_slots(F.col("gammas")))
    x, y, z, slots = F.col("x"), F.col("y"), F.col("z"), F.col("gammas")
    values = [x, y, z, F.col(material), F.col(volume), geo.clamped(F.col("gamma_amount").cast("double")), geo.clamped(F.col("gamma_total"))]
    values += [geo.radius(x, y), geo.azimuth(x, y), F.lit(g.radius) - geo.radius(x, y), z.cast("double") - g.cut_bottom, F.lit(g.cut_top) - z.cast("double")]
    values += [geo.mean_direction(slots, "r"), geo.mean_direction(slots, "z")]
    values += [slots[i][n] for i in range(4) for n in ("e", "px", "py", "pz")]
    keys = [c for c in ("source_file", *KEY) if c in captures.columns]
    return nc.select(*keys, *[v.cast("float").alias(name) for v, name in zip(values, PHI)], *kept)


def with_targets(captures: DataFrame, regions: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Every capture once, also those without hits, with its counts or 0."""
    names = ["total_hits", *LAYERS, "voxels_hit"]
    joined = captures.join(regions.select(*keys, *names, "voxel_hits"), list(keys), "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names} | {"voxel_hits": F.coalesce("voxel_hits", none)})


def completeness(captures: DataFrame, rows: DataFrame, by: str = "file_idx") -> DataFrame:
    """Captures in and rows out per file, and whether they agree."""
    n_in = captures.groupBy(by).agg(F.count("*").alias("n_in"))
    n_out = rows.groupBy(by).agg(F.count("*").alias("n_out"))
    both = n_in.join(n_out, by, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_out")})
    return both.withColumn("complete", F.col("n_in") == F.col("n_out"))


def voxel_metadata(voxels: DataFrame) -> DataFrame:
    """One-hot layer, cylindrical coordinates, and the corners turned into x[], y[], z[] if they are there."""
    x, y = F.col("center")[0], F.col("center")[1]
    flags = [(F.lower("layer") == name).cast("float").alias(f"is_{name}") for name in LAYERS]
    corners = [F.transform("corners", lambda c: c[i]).alias(f"corner_{n}") for i, n in enumerate("xyz")] if "corners" in voxels.columns else []  # noqa: B023
    return voxels.select(F.col("index").alias("voxel_index"), *flags, geo.radius(x, y).cast("float").alias("r"), geo.azimuth(x, y).cast("float").alias("phi"), F.col("center")[2].cast("float").alias("z"), *corners)
