"""Nearest voxel centre (exact 1-NN in three dimensions) as DataFrame operations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitlake.sources.scratch import materialise

MOST_BROADCAST = 20_000  # voxels; a voxel table is a fixed detector description, checked against this before a broadcast
MOST_NEAR = 64  # centres that a hit is compared with in its cell
FINER = 4  # factor between the cells of two levels
PER_LEAF = 16
MOST_TREE = 50_000  # centres, of about 60 bytes, of a tree that all tasks hold
ENLARGE = 2  # factor of the cell from one round to the next, with more centres than that
_BOX = [f"{end}{c}" for c in "xyz" for end in ("lo", "hi")]


def _d2(x: Column, y: Column, z: Column) -> Column:
    parts = [F.col(c).cast("double") - v for c, v in zip("xyz", (x, y, z))]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def nearest_brute(hits: DataFrame, voxels: DataFrame) -> DataFrame:
    """Every voxel is looked at inside the row: for few voxels, and to hold `nearest_grid` against.

    Ties go to the smallest position in the list. The list's size is checked; more voxels than that need `nearest_grid`.
    """
    n = voxels.count()
    if n > MOST_BROADCAST:
        raise ValueError(f"{n} voxels are too many to look through for every hit; use nearest_grid")
    listed = voxels.agg(F.sort_array(F.collect_list(F.struct("ord", "index", "center", "layer"))).alias("_voxels"))
    best = F.aggregate(
        "_voxels",
        F.struct(F.lit(float("inf")).alias("d2"), F.lit(None).cast("int").alias("ord"), F.lit("-1").alias("index"), F.lit(None).cast("string").alias("layer")),
        lambda a, v: F.when(_d2(*[v["center"][i] for i in range(3)]) < a["d2"], F.struct(_d2(*[v["center"][i] for i in range(3)]).alias("d2"), v["ord"].cast("int").alias("ord"), v["index"].alias("index"), v["layer"].alias("layer"))).otherwise(a),
    )
    found = hits.join(F.broadcast(listed)).withColumn("_best", best).drop("_voxels")
    return found.select(*hits.columns, F.col("_best.index").alias("voxel_index"), F.col("_best.ord").alias("voxel_ord"), F.col("_best.layer").alias("layer"))


def centres(voxels: DataFrame) -> DataFrame:
    """Distinct centres with the first voxel of the list that has each: a later one with the same centre is never the nearest."""
    at = [F.col("center")[i].cast("double").alias(f"_v{c}") for i, c in enumerate("xyz")]
    rows = voxels.select(*at, F.struct(F.col("ord").cast("int").alias("ord"), "index", "layer").alias("_voxel"))
    return rows.where("_vx is not null and _vy is not null and _vz is not null").groupBy("_vx", "_vy", "_vz").agg(F.min("_voxel").alias("_voxel"))


def fitted_cell(points: DataFrame) -> tuple[int, float]:
    """Number of centres, and the edge of a cube that holds one centre on average."""
    row = points.agg(F.count("*").alias("n"), *[(F.max(f"_v{c}") - F.min(f"_v{c}")).alias(c) for c in "xyz"]).first()
    if not row["n"]:
        return 0, 1.0
    sides = [s for s in (row["x"], row["y"], row["z"]) if s]  # a flat detector has fewer
    volume = 1.0
    for s in sides:
        volume *= s
    return row["n"], (volume / row["n"]) ** (1 / len(sides)) if sides else 1.0


def _at(c: Column, cell: float, step: Column | int = 0) -> Column:
    return (F.floor(c / cell) + step).cast("bigint")


def _filed(points: DataFrame, cell: float, parents: DataFrame | None = None, most: int | None = MOST_NEAR) -> DataFrame:
    """(_cx, _cy, _cz, _near, _full): every cell with the centres of the 27 cells around it; lists of more than `most` are left out and marked.

    With `parents` only the cells inside those (of FINER times the size) are made.
    """
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    filed = points
    for c in "xyz":
        filed = filed.withColumn("_step", F.explode(steps)).withColumn(f"_c{c}", _at(F.col(f"_v{c}"), cell, F.col("_step"))).drop("_step")
    if parents is not None:
        up = [F.shiftright(f"_c{c}", FINER.bit_length() - 1) == F.col(f"_p{c}") for c in "xyz"]
        filed = filed.join(parents.select(*[F.col(f"_c{c}").alias(f"_p{c}") for c in "xyz"]), up[0] & up[1] & up[2], "left_semi")
    near = F.collect_list(F.struct("_vx", "_vy", "_vz", "_voxel"))
    few = F.lit(True) if most is None else F.size("_near") <= most
    return filed.groupBy("_cx", "_cy", "_cz").agg(near.alias("_near")).select("_cx", "_cy", "_cz", F.when(few, F.col("_near")).alias("_near"), (~few).alias("_full"))


def levels(points: DataFrame, cell: float) -> list[tuple[float, DataFrame]]:
    """(cell, cells) from coarse to fine: where the centres are dense, the cells of the next level take over."""
    out = [(cell, materialise(_filed(points, cell)))]
    while not (full := out[-1][1].where("_full")).isEmpty():
        cell /= FINER
        out.append((cell, materialise(_filed(points, cell, full))))
    return out


def tree(points: DataFrame, n: int) -> DataFrame:
    """One row, one value: the centres sorted into columns of leaves of about PER_LEAF, each with the box around it.

    Slices of equal numbers along x, inside these along y, inside these along z: dense regions have small boxes.
    """
    slices = max(1, math.ceil((n / PER_LEAF) ** (1 / 3)))
    at, cuts = points, []
    for c, rest in (("x", "yz"), ("y", "zx"), ("z", "xy")):
        order = [f"_v{c}", *[f"_v{r}" for r in rest]]
        at = at.withColumn(f"_s{c}", F.ntile(slices).over((Window.partitionBy(*cuts) if cuts else Window.partitionBy(F.lit(0))).orderBy(*order)))  # a detector description
        cuts.append(f"_s{c}")
    box = lambda lo, hi: [f.alias(n) for c in "xyz" for f, n in ((F.min(lo.format(c)), f"lo{c}"), (F.max(hi.format(c)), f"hi{c}"))]
    leaves = at.groupBy(*cuts).agg(*box("_v{}", "_v{}"), F.collect_list(F.struct("_vx", "_vy", "_vz", "_voxel")).alias("of"))
    columns = leaves.groupBy(*cuts[:2]).agg(F.collect_list(F.struct(*_BOX, "of")).alias("of"), *box("lo{}", "hi{}"))
    return columns.agg(F.collect_list(F.struct(*_BOX, "of")).alias("_tree"))


def _nearest_of(near: Column) -> Column:
    return F.array_min(F.transform(near, lambda v: F.struct(_d2(v["_vx"], v["_vy"], v["_vz"]).alias("d2"), v["_voxel"].alias("voxel"))))


def _through_tree(whole: Column) -> Column:
    """The nearest centre by bounds: boxes that begin farther away than another one ends are not opened.

    The bounds are sums of the same terms as the distance, in the same order, so rounding cannot put a centre outside its box.
    """

    def bound(box: Column, far: bool) -> Column:
        parts = []
        for c in "xyz":
            x = F.col(c).cast("double")
            below, above = box[f"lo{c}"] - x, x - box[f"hi{c}"]
            parts.append(F.greatest(-below, -above) if far else F.greatest(below, above, F.lit(0.0)))
        return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]

    bind = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  computed once a row
    opened = lambda boxes: bind(F.array_min(F.transform(boxes, lambda b: bound(b, True))), lambda u: F.filter(boxes, lambda b: bound(b, False) <= u))
    inside = lambda boxes: F.flatten(F.transform(boxes, lambda b: b["of"]))
    return bind(inside(opened(whole)), lambda leaves: _nearest_of(inside(opened(leaves))))


@dataclass(frozen=True)
class Search:
    """What a search needs of the voxels: written once, for as many tables of hits as there are."""

    points: DataFrame
    n: int
    cell: float
    by_level: list[tuple[float, DataFrame]]
    whole: Column | None  # the tree, if it may be sent


def prepared(voxels: DataFrame, cell: float | None = None) -> Search:
    """`cell` follows from the density of the centres if it is not given."""
    points = materialise(centres(voxels))
    n, fitted = fitted_cell(points)
    cell = cell or fitted
    return Search(points, n, cell, levels(points, cell), materialise(tree(points, n)).scalar() if n <= MOST_TREE else None)


def nearest_grid(hits: DataFrame, voxels: DataFrame | Search, cell: float | None = None) -> DataFrame:
    """Exact nearest centre among `voxels`, which may be `prepared`; `cell` follows from their density if it is not given.

    Each hit meets one list, that of its cell on the level that fits the density there, of MOST_NEAR centres at most. Every
    centre within the cell's size of the hit is among them, so a best distance up to that is proven. The other hits,
    farther from any centre, go through a tree of boxes that all tasks hold; so hits are read once, neither multiplied,
    grouped nor written. More than MOST_TREE centres are too many to send: then these hits look again with larger cells,
    round by round. Hits with a position that is not finite, and all hits if there is no voxel, get the index -1.
    """
    search = voxels if isinstance(voxels, Search) else prepared(voxels, cell)
    points, n, cell = search.points, search.n, search.cell
    finite = F.lit(n > 0)
    for c in "xyz":
        v = F.col(c).cast("double")
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    named = lambda df, best: df.select(*hits.columns, F.coalesce(best["voxel"]["index"], F.lit("-1")).alias("voxel_index"), best["voxel"]["ord"].alias("voxel_ord"), best["voxel"]["layer"].alias("layer"))
    met, reach = _meet(hits.withColumn("_finite", finite), search.by_level, n)
    proven = ~F.col("_finite") | F.coalesce(F.col("_best.d2") <= reach * reach, F.lit(False))
    met = met.withColumn("_best", F.when(F.col("_finite"), F.col("_best")))
    if search.whole is not None:  # only the rows that are not proven get it as a column
        met = met.withColumn("_tree", F.when(~proven, search.whole))
        return named(met.withColumn("_best", F.when(F.col("_tree").isNull(), F.col("_best")).otherwise(_through_tree(F.col("_tree")))), F.col("_best"))
    found = materialise(met.withColumn("_proven", proven))
    out = named(found.where("_proven"), F.col("_best"))
    rest = found.where("not _proven")
    while not rest.isEmpty():
        cell *= ENLARGE
        near = _filed(points, cell, most=None).drop("_full")
        keyed = rest.drop("_best", "_proven").withColumns({f"_c{c}": _at(F.col(c).cast("double"), cell) for c in "xyz"})
        found = materialise(keyed.join(near, ["_cx", "_cy", "_cz"], "left").withColumn("_best", _nearest_of(F.col("_near"))).drop("_near", "_cx", "_cy", "_cz"))
        ok = F.coalesce(F.col("_best.d2") <= cell * cell, F.lit(False))
        out = out.unionByName(named(found.where(ok), F.col("_best")))
        rest = found.where(~ok)
    return out


def spread(hits: DataFrame) -> DataFrame:
    """Matched hits dealt evenly over the tasks: the search costs far more than a hit's bytes tell, and a file of one row group is one task."""
    return hits.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _meet(hits: DataFrame, by_level: list[tuple[float, DataFrame]], n: int) -> tuple[DataFrame, Column]:
    """hits with _best (d2, voxel) among the centres near them, null if there are none; and the distance up to which that is proven."""
    met, near, reach, deeper = hits, [], [], F.lit(True)
    for i, (cell, filed) in enumerate(by_level):
        keys = [f"_c{c}{i}" for c in "xyz"]
        met = met.withColumns({k: F.when(deeper, _at(F.col(c).cast("double"), cell)) for k, c in zip(keys, "xyz")})
        filed = filed.select(*[F.col(f"_c{c}").alias(k) for k, c in zip(keys, "xyz")], F.col("_near").alias(f"_near{i}"), F.col("_full").alias(f"_full{i}"))
        met = met.join(F.broadcast(filed) if n <= MOST_BROADCAST else filed, keys, "left").drop(*keys)
        near.append(F.col(f"_near{i}"))
        reach.append(F.when(F.col(f"_near{i}").isNotNull(), cell))
        deeper = F.coalesce(F.col(f"_full{i}"), F.lit(False))
    met = met.withColumns({"_best": _nearest_of(F.coalesce(*near)), "_reach": F.coalesce(*reach)})
    return met.drop(*[f"_{k}{i}" for k in ("near", "full") for i in range(len(by_level))]), F.col("_reach")
