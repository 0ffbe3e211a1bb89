"""Histogram edges and one binning operator. Bins are half-open, the last one closed; values outside are dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear(lo: float, hi: float, bins: int) -> list[float]:
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def log_space(lo_exponent: float, hi: float, edges: int) -> list[float]:
    """`edges` edges from 10**lo_exponent to hi, evenly spaced in the exponent; the last one is hi itself."""
    top = math.log10(hi)
    return [10 ** (lo_exponent + (top - lo_exponent) * i / (edges - 1)) for i in range(edges - 1)] + [hi]


def zero_and_log(most: float, log_edges: int = 29) -> list[float]:
    """A bin for zero, then logarithmic bins up to the largest value."""
    return [0.0, 0.5, *log_space(0.0, max(most, 1.000001), log_edges)]


def small_counts(most: int = 100) -> list[float]:
    return [-0.5, 0.5, *[float(x) for x in range(1, most + 2, 2)]]


def symmetric_log(lo: float, hi: float, edges: int = 50) -> list[float]:
    """Ascending: mirrored logarithmic edges below -1, one linear stretch around 0, logarithmic edges above 1."""
    below = [-x for x in reversed(log_space(0.0, -lo, edges))] if lo < -1 else []
    above = log_space(0.0, hi, edges) if hi > 1 else []
    return [*below, *([-1.0] if not below else []), 0.0, *([1.0] if not above else []), *above]


def place(value: Column, edges: list[float]) -> Column:
    """The bin of a value between the first and the last edge, by halving the edges: plain comparisons, compiled."""

    def half(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(float(edges[mid])), half(lo, mid)).otherwise(half(mid, hi))

    return half(0, len(edges) - 1)


def histogram(rows: DataFrame, value: str, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, lo, hi, n) for every bin, also empty ones. Rows are binned where they are; only bins are shuffled."""
    spark, n = rows.sparkSession, len(edges) - 1
    v = F.col(value).cast("double")
    sums = rows.where(v.between(float(edges[0]), float(edges[-1]))).groupBy(*by, place(v, edges).alias("bin")).agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(n)], "bin int, lo double, hi double")
    if by:
        table = rows.select(*by).distinct().join(F.broadcast(table))  # the list of edges: a few dozen rows
        same = [table[c].eqNullSafe(sums[c]) for c in (*by, "bin")]
        return table.join(sums, same, "left").select(*[table[c] for c in by], table["bin"], "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
    return table.join(sums, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """(bin_x, bin_y, n) of evenly spaced edges; occupied bins only. Arithmetic, no look-up of edges."""

    def at(c: str, edges: list[float]):
        n, lo, hi = len(edges) - 1, float(edges[0]), float(edges[-1])
        return F.least(F.floor((F.col(c).cast("double") - lo) * n / (hi - lo)), F.lit(n - 1)).cast("int")

    inside = F.col(x).between(float(x_edges[0]), float(x_edges[-1])) & F.col(y).between(float(y_edges[0]), float(y_edges[-1]))
    return df.where(inside).groupBy(at(x, x_edges).alias("bin_x"), at(y, y_edges).alias("bin_y")).agg(F.count("*").alias("n"))


def largest(df: DataFrame, value: str, otherwise: float = 0.0) -> float:
    """The one scalar that data-dependent edges need."""
    got = df.agg(F.max(F.col(value).cast("double"))).first()[0]
    return otherwise if got is None else float(got)


def smallest(df: DataFrame, value: str, otherwise: float = 0.0) -> float:
    got = df.agg(F.min(F.col(value).cast("double"))).first()[0]
    return otherwise if got is None else float(got)
