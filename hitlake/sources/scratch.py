"""Intermediate tables in the folder that the session's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a plain local[*] session may leave it unset; it then gets one temporary folder per application.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-hitlake-")
    return _own[app]


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    With `by`, its last columns, a filter on these opens only the files that it needs.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/hitlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def existing(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What an earlier run left, or nothing if the path is not there; anything else that is wrong with it is an error."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Results of steps that do not need each other: their jobs share the cluster, so that small ones do not wait in line."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


AHEAD = 3


def in_turn(spark: SparkSession, make: Callable[[int], object], n: int) -> Iterator:
    """make(0), ..., make(n - 1) in this order; up to AHEAD of them are worked on before they are asked for."""
    with ThreadPoolExecutor(AHEAD) as pool:
        begin = lambda i: pool.submit(inheritable_thread_target(spark)(make), i)  # noqa: E731  properties of its own for each
        begun = deque(begin(i) for i in range(min(AHEAD, n)))
        for i in range(n):
            done = begun.popleft().result()
            if i + AHEAD < n:
                begun.append(begin(i + AHEAD))
            yield done
