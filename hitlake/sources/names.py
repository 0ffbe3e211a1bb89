"""Versioned dictionaries: several jobs may extend one at a time, and no name or id is given twice.

A dictionary is a folder. Its versions are small files `v-0000000001`, ..., each naming the data of that version. A job
writes its data and a file of its own that names them, and takes a version by moving that file to the version's name,
which fails if another job was first. That job's names are then read, and the rest is added to them. So a version is
there with its data or not at all, and ids are never given twice, wherever the file system moves files that way (HDFS
and those like it; on a local disk a hard link is made instead).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from hitlake.operators import dictionary
from hitlake.sources import readers, sinks

ATTEMPTS = 100


def _file(spark: SparkSession, path: str):
    """(file system, path) of the cluster's file system API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, data folder) of the last version; (0, None) before the first."""
    fs, at = _file(spark, path)
    found = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("v-")) if fs.exists(at) else []
    if not found:
        return 0, None
    stream = fs.open(_file(spark, f"{path}/{found[-1]}")[1])
    data = bytes(stream.readAllBytes()).decode()
    stream.close()
    return int(found[-1][2:]), data


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, id) of the last version, None before the first."""
    data = version(spark, path)[1]
    return None if data is None else readers.read_dictionary(spark, f"{path}/{data}")


def take(spark: SparkSession, path: str, number: int, full: DataFrame) -> bool:
    """Write a dictionary as version `number`; False if another job has taken that number."""
    data = f"data-{uuid.uuid4().hex}"
    sinks.write_dictionary(full, f"{path}/{data}")
    fs, own = _file(spark, f"{path}/own-{data}")
    out = fs.create(own, False)
    out.write(data.encode())
    out.close()
    target = _file(spark, f"{path}/v-{number:010}")[1]
    jvm = spark._jvm
    try:
        if fs.getScheme() == "file":
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, own)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(own, target, spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def grow(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Extend the dictionary by the names it lacks and return what it then is: known ids stay, new ones follow by name."""
    for _ in range(ATTEMPTS):
        number, data = version(spark, path)
        known = None if data is None else readers.read_dictionary(spark, f"{path}/{data}")
        if known is not None and names.select("name").join(known, "name", "left_anti").isEmpty():
            return known
        if take(spark, path, number + 1, dictionary.extend(names, known)):
            return read(spark, path)
    raise RuntimeError(f"{path}: {ATTEMPTS} other jobs were first")
