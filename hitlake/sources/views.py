"""Captures, hits, voxels and dictionaries derived from the driver's tables (FIXTURES section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_file(index: str) -> str:
    """A path with a run and a file name for a file index, as SQL of both engines."""
    return f"concat('data/run', lpad(cast({index} % 10 + 1 as string), 3, '0'), '/output_', lpad(cast({index} as string), 6, '0'), '.parquet')"


#: Detector-like names by key, as SQL of both engines: most rules, the literal names and some names without a group.
VOLUME_NAME = (
    "case {k} % 16 when 0 then concat('V', lpad(cast({k} % 10000 as string), 4, '0')) when 1 then concat('V', lpad(cast({k} % 10000 as string), 4, '0'), '_pen')"
    " when 2 then concat('PMT', lpad(cast({k} % 1000000 as string), 6, '0')) when 3 then concat('PMT300', lpad(cast({k} % 10000 as string), 4, '0'))"
    " when 4 then concat('S', lpad(cast({k} % 10000 as string), 4, '0'), 'B') when 5 then concat('S', lpad(cast({k} % 10000 as string), 4, '0'), 'T_wrap')"
    " when 6 then concat('fiber_core_l', cast({k} % 100 as string), '.5') when 7 then concat('V', lpad(cast({k} % 10000 as string), 4, '0'), '_hv_cable_string_', cast({k} % 11 as string))"
    " when 8 then concat('string_', cast({k} % 12 as string), '_cu_rod_', cast({k} % 4 as string)) when 9 then concat('tristar_xlarge_string_', cast({k} % 12 as string))"
    " when 10 then 'tank' when 11 then 'water' when 12 then 'my_tyvek_pit_foil' when 13 then concat('unknown_', cast({k} % 7 as string)) when 14 then 'noVolume' else '' end"
)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records from orders; every 17th key twice, the later record with a later time."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = "o_orderkey"
    gammas = ", ".join(f"struct(cast((({k} * {i}) % 9) * 100 - 100 as double) as e, cast(((o_custkey + {i}) % 5 - 2) as double) / 2 as px, cast((({k} + {i}) % 7 - 3) as double) / 3 as py, cast((({k} * {i}) % 11 - 5) as double) / 5 as pz)" for i in range(1, 5))
    rows = rows.selectExpr(
        f"cast({k} div 1000 as int) as file_idx", f"({k} % 1000) div 4 as evtid", f"{k} % 4 as nc_id", f"{k} % 17 = 0 as twice", f"cast(datediff(cast(o_orderdate as date), date '1992-01-01') as double) as nc_time",
        "cast((o_custkey % 80) - 40 as double) * 0.1D as x", f"cast(({k} % 90) - 45 as double) * 0.09D as y", f"cast({k} % 89 as double) * 0.1D - 4.979D as z",
        f"cast({k} % 7 - 1 as int) as gamma_amount", "o_totalprice / 10 - 500 as gamma_total", f"array({gammas}) as gammas", "o_orderpriority as material",
        f"case when {k} % 23 = 0 then '' else coalesce(c_mktsegment, '') end as volume", f"{VOLUME_NAME.format(k=k)} as phys_volume", f"{k} % 19 = 0 as flag",
    )
    both = rows.withColumn("row_ix", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.withColumn("nc_time", F.col("nc_time") + 5.0 * F.col("row_ix")).drop("twice")


def photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector hits from lineitem; no capture (-1) for every 13th part."""
    k = "l_orderkey"
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as photon_id", f"cast({k} div 1000 as int) as file_idx", f"({k} % 1000) div 4 as evtid", f"case when l_partkey % 13 = 0 then -1L else {k} % 4 end as nc_id", "1963 + l_linenumber as det_uid",
        "cast(((l_partkey % 100) - 49.5D) * 0.09D as float) as x", "cast(((l_suppkey % 100) - 49.5D) * 0.09D as float) as y", "cast(l_quantity * 0.2D - 5.2D as float) as z",
        "cast(l_discount - 0.05D as float) as px", "cast(l_tax - 0.04D as float) as py", "cast((l_linenumber - 4) / 4.0D as float) as pz", "cast(datediff(cast(l_shipdate as date), date '1992-01-01') as double) as time",
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels from part, one each; centres repeat after a while, so there are ties."""
    k = "p_partkey"
    return _table(spark, sf_dir, "part").selectExpr(
        f"cast({k} as int) as ord", f"cast({k} as string) as index",
        f"array(cast(({k} * 37 % 80 - 40) * 100 as double), cast(({k} * 53 % 80 - 40) * 100 as double), cast(({k} * 71 % 90) * 100 - 4979 as double)) as center",
        f"case {k} % 5 when 0 then 'Pit' when 1 then 'bot' when 2 then 'WALL' when 3 then 'top' else 'other' end as layer",
    )


def local_dictionary(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(file_idx, local_id, name): the same name has another id in another file. Ranks are over the few distinct names."""
    rows = captures(spark, sf_dir).select("file_idx", F.col(column).alias("name")).distinct()
    ranks = rows.select("name").distinct().select("name", F.row_number().over(Window.orderBy("name")).alias("rank"))
    return rows.join(ranks, "name").select("file_idx", ((F.col("rank") + F.col("file_idx")) % 7).alias("local_id"), "name")


def with_local_ids(spark: SparkSession, sf_dir: str, local: dict[str, DataFrame] | None = None) -> DataFrame:
    """Captures that carry file-local ids instead of names, as raw files do; `local`: the local dictionaries by column, if they are made already."""
    nc = captures(spark, sf_dir)
    for column, out in (("material", "mat_local"), ("volume", "vol_local")):
        names = (local[column] if local else local_dictionary(spark, sf_dir, column)).withColumnRenamed("name", column).withColumnRenamed("local_id", out)
        nc = nc.join(names, ["file_idx", column])
    return nc
