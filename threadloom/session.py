"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("threadloom")
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's workers, once: functions that run in tasks are looked up in it by name.

    The driver's own copy is zipped and served by Spark, so executors need neither an installation nor a shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="threadloom-"), "threadloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("threadloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
