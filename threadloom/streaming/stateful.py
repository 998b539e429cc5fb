"""Streaming twins of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.dedupe import append_new


def new_only(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose key has not come within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Threads by gap as session windows: first and last time, and rows, of each."""
    grouped = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")


def windowed_counts(stream: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def append_if_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append each batch's rows whose keys the target lacks; a batch run again adds nothing twice.

    Duplicates within a batch are kept to one."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = append_new(spark.read.schema(batch.schema).parquet(target), fresh, keys)
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
