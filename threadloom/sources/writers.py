"""Sinks: partitioned Parquet, JSON lines, CSV rows, and guards."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 5_000_000


def write_splits(df: DataFrame, path: str, order: list[str], codec: str = "zstd", overwrite: bool = False, rows: int = MAX_ROWS) -> None:
    """One folder a split, files of at most `rows` rows sorted by `order`; a target with data is refused unless overwritten."""
    ranged = df.repartitionByRange("split", *order).sortWithinPartitions("split", *order)
    mode = "overwrite" if overwrite else "errorifexists"
    ranged.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", rows).partitionBy("split").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_pretty(df: DataFrame, path: str, key: str, per_file: int = 1000) -> None:
    """JSON documents of many lines, a row each, other letters than ASCII as they are; files of at most `per_file` of them."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(F.col(key).alias("key"), text.alias("value")).sortWithinPartitions("key").select("value").write.option("lineSep", "\n\n").option("maxRecordsPerFile", per_file).text(path)


def write_states(df: DataFrame, path: str, key: str) -> None:
    """One JSON file a row, in a folder named by its key: a submission's state, written anew each time it is saved.

    Only the folders of the keys written are replaced."""
    state = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(F.col(key).cast("string").alias("key"), state.alias("value")).repartition("key")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").text(path)


def append_submission(df: DataFrame, path: str) -> None:
    """Rows as CSV in files of their own, so that writers do not meet."""
    df.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table bucketed by its join keys, so that joins and counts on them need no shuffle; its files lie under `path`, else in the warehouse."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def fingerprint(params: dict) -> str:
    """Eight digits that name a run's parameters."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:8]


def cache_name(least: int, most: int, samples: int | None, fraction: float, history: int | None = None) -> str:
    return f"min{least}-max{most}-maxs{samples}-gfrac{fraction}" + (f"-hl{history}" if history is not None else "")


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))
