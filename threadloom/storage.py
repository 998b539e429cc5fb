"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, one of our own, and only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _HELD[path] = spark
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    _HELD.pop(path, None)
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a finished folder to where readers look for it; false, and nothing changed, if one is there already."""
    fs, at = file_system(spark, target)
    fs.mkdirs(at.getParent())
    return not fs.exists(at) and fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if it is missing."""
    fs, at = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


@atexit.register
def _cleared() -> None:
    for path, spark in list(_HELD.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder is scratch space
            remove(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df` written to a path and read back: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
