"""Column expressions: regions, directions, cylindrical coordinates, gamma slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitlake.schema import Geometry


def mm(c: Column, scale: float = 1000.0) -> Column:
    """Metres to millimetres in single precision."""
    return c.cast("float") * F.lit(scale).cast("float")


def region(z: Column, g: Geometry = Geometry()) -> Column:
    return F.when(z <= g.cut_bottom, "bot").when(z >= g.cut_top, "top").otherwise("barrel")


def valid_direction(x: Column, y: Column, z: Column, px: Column, py: Column, pz: Column, g: Geometry = Geometry()) -> Column:
    """Out of the surface: down at the bottom, up at the top, outward at the barrel (outward: x px + y py >= 0)."""
    return F.when(z <= g.cut_bottom, pz <= 0).when(z >= g.cut_top, pz >= 0).otherwise(x * px + y * py >= 0)


def finite(*columns: Column) -> Column:
    """Neither NaN nor infinite nor null: such rows count as invalid before any comparison (Spark orders NaN above all)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def radius(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.sqrt(x * x + y * y)


def azimuth(x: Column, y: Column) -> Column:
    return F.atan2(y.cast("double"), x.cast("double"))


def clamped(c: Column) -> Column:
    """Negative values (sentinels) become 0."""
    return F.when(c > 0, c).otherwise(F.lit(0).cast("double"))


def gamma_slots(gammas: Column) -> Column:
    """Slots with negative energy are empty: all four values 0."""
    names = ("e", "px", "py", "pz")
    return F.transform(gammas, lambda g: F.when(g["e"] < 0, F.struct(*[F.lit(0.0).alias(n) for n in names])).otherwise(F.struct(*[g[n].alias(n) for n in names])))


def mean_direction(gammas: Column, part: str) -> Column:
    """Mean over slots with energy > 0 of the transverse ("r") or axial ("z") direction; 0 without any."""
    value = (lambda g: F.sqrt(g["px"] * g["px"] + g["py"] * g["py"])) if part == "r" else (lambda g: g["pz"])
    lit = F.filter(gammas, lambda g: g["e"] > 0)
    return F.when(F.size(lit) > 0, F.aggregate(lit, F.lit(0.0), lambda a, g: a + value(g)) / F.size(lit)).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
