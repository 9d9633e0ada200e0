"""Tables that are derived once in a session and read from the shared folder after that."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it names none, a local session gets
    one of its own, as in tests; on a cluster that is an error, because other machines would not find the files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a path and its file system, of the JVM
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, folder: str) -> tuple:
    """Path, size and time of every file under a folder: a changed table is another version, also one that is a folder of
    parts."""
    at, files = _path(spark, folder)
    found, listed = [], files.listFiles(at, True)
    while listed.hasNext():
        one = listed.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


def folder_of(spark: SparkSession, key: tuple, write: Callable[[str], None]) -> str:
    """The folder in which write(folder) has put what belongs to the key; written at the first call of a session, and again
    if it is gone."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _WRITTEN:
        at, files = _path(spark, f"{_WRITTEN[key]}/done")
        if files.exists(at):
            return _WRITTEN[key]
    folder = f"{shared_folder(spark)}/stored/{uuid.uuid4().hex}"
    write(folder)
    at, files = _path(spark, f"{folder}/done")
    files.mkdirs(at)
    _WRITTEN[key] = folder
    return folder


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a Parquet table that later calls with the same key read."""
    folder = folder_of(spark, key, lambda f: make().write.parquet(f"{f}/table"))
    return spark.read.parquet(f"{folder}/table")
