"""Places of rows in a total order, and order statistics, without a window or a buffer that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.sources.scratch import materialise


def _ranged(df: DataFrame, by: str) -> DataFrame:
    """df in ranges of `by`, written once: `_range` ascends with `by`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, by).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of `by`, whose values are distinct.

    Rows are numbered inside ranges; the ranges' sizes, one small row each, tell where each range begins.
    """
    rows = _ranged(df, by)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return rows.join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + inside).drop("_range", "_begin")


BINS = 4096  # of each interval that holds a wanted rank


def quantiles_of(rows: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, with linear interpolation between neighbours; nulls and NaN are ignored, None without any value.

    Selection by refined histograms: a pass counts the values of all columns in the bins of the intervals that hold a
    wanted rank, before anything is shuffled, and a rank's bin, from its least to its greatest value, is the interval of
    the next pass. It ends when all values of a bin are equal. No value leaves its task: counts and ends of bins do. Each
    pass reads `rows` once, so these should be a written table, not a join.
    """
    names = list(shares)
    value = {c: F.col(f"`{c}`").cast("double") for c in names}
    known = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in known.items()}
    parts = [f(x).alias(f"{k}{i}") for i, c in enumerate(names) for k, f, x in (("n", F.count, known[c]), ("lo", F.min, finite[c]), ("hi", F.max, finite[c]), ("below", F.count, F.when(known[c] == float("-inf"), 1)), ("above", F.count, F.when(known[c] == float("inf"), 1)))]
    ends = rows.agg(*parts).first()
    total = {c: ends[f"n{i}"] for i, c in enumerate(names)}
    wanted = {c: sorted({k for s in shares[c] for k in _neighbours(s, total[c])}) if total[c] else [] for c in names}
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    open_: dict[tuple[int, float, float], tuple[int, list[int]]] = {}  # (column, least, greatest): rank of the first value, wanted ranks
    for i, c in enumerate(names):
        first, last = ends[f"below{i}"], total[c] - ends[f"above{i}"]
        found[c] |= {k: float("-inf") for k in wanted[c] if k < first} | {k: float("inf") for k in wanted[c] if k >= last}
        inside = [k for k in wanted[c] if first <= k < last]
        if inside:
            open_[i, ends[f"lo{i}"], ends[f"hi{i}"]] = first, inside
    while open_:
        for i, lo, hi in [at for at in open_ if at[1] == at[2]]:
            found[names[i]] |= {k: lo for k in open_.pop((i, lo, hi))[1]}
        if not open_:
            break
        intervals = list(open_)
        bins = []
        for i, c in enumerate(names):
            case = None
            for j, (column, lo, hi) in enumerate(intervals):
                if column == i:  # halves, so that no difference overflows; every step of this keeps the order
                    at = F.floor((finite[c] / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS).cast("int")
                    cell = F.struct(F.lit(j).alias("interval"), at.alias("bin"), finite[c].alias("v"))
                    inside = finite[c].between(lo, hi)
                    case = F.when(inside, cell) if case is None else case.when(inside, cell)
            if case is not None:
                bins.append(case)
        cells = rows.select(F.explode(F.array(*bins)).alias("_c")).where("_c is not null").select("_c.*")
        counted = cells.groupBy("interval", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = sorted((r["interval"], r["bin"], r["n"], r["lo"], r["hi"]) for r in counted.collect())  # BINS rows an interval at most
        refined = {}
        for j, (i, lo, hi) in enumerate(intervals):
            begin, asked = open_[i, lo, hi]
            for _, _, n, least, greatest in [r for r in counts if r[0] == j]:
                mine = [k for k in asked if begin <= k < begin + n]
                if mine:
                    refined[i, least, greatest] = begin, mine
                begin += n
        open_ = refined
    return {c: [_between(s, total[c], found[c]) for s in shares[c]] for c in names}


def _neighbours(share: float, total: int) -> tuple[int, int]:
    place = int(share * (total - 1))
    return place, min(total - 1, place + 1)


def _between(share: float, total: int, at: dict[int, float]) -> float | None:
    if not total:
        return None
    low, high = (at[k] for k in _neighbours(share, total))
    part = share * (total - 1) - int(share * (total - 1))
    return low if low == high or not part else low + (high - low) * part


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """`quantiles_of` for one column."""
    return quantiles_of(rows, {value: shares})[value]
