"""Run a stream over what there is now, for backfills and for comparison with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.storage import fresh_path, remove


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result once all present input is read: the last state ("complete") or all rows ("append")."""
    spark, folder = stream.sparkSession, fresh_path(stream.sparkSession, "stream")
    kept = "overwrite" if mode == "complete" else "append"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode(kept).parquet(f"{folder}/rows")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    remove(spark, f"{folder}/state")  # the stream is over
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
