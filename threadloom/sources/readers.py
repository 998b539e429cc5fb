"""Sources: local mirrors of hub datasets, CSV, JSON and cache files, always with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.schemas import INTERACTION


#: Patterns that select_sources compares every source with.
MOST_PATTERNS = 10_000


def interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTION).parquet(path)


def tagged(df: DataFrame, config: str, split: str) -> DataFrame:
    return df.withColumns({"__config_name__": F.lit(config), "__split_name__": F.lit(split)})


def selected(names: list[str], patterns: list[str]) -> list[str]:
    """Names that a pattern matches at their start, once for each pattern that does; an error if none does."""
    found = [n for p in patterns for n in names if re.match(p, n)]
    if not found:
        raise ValueError(f"no source matches {patterns}")
    return found


def select_sources(catalog: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """`selected` over a catalog of sources; the list of patterns is the user's own, of at most MOST_PATTERNS."""
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return catalog.join(F.broadcast(patterns), F.expr(f"{name} rlike concat('^(?:', {pattern}, ')')"))


def sliced(sources: list[DataFrame], most: int, splits: int, order: list[str]) -> DataFrame:
    """The first rows of each source, max(50, most // sources // splits) of them, for trials."""
    n = max(50, most // max(1, len(sources)) // max(1, splits))
    parts = [s.orderBy(*order).limit(n) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mail_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Quoted CSV of (file, message) with messages over many lines; `most`: the first rows by file and message."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("message", T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", 10_000_000).csv(path)
    return df if most is None else df.orderBy("file", "message").limit(most)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The transcript cache: an id, a text and a line of dashes a record."""
    rows = spark.read.option("lineSep", "\n--------\n").text(path).where(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    return rows.select(parts[0].alias("video_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("video_transcript"))


def bad_transcripts(df: DataFrame, sentinel: str = "Not available.") -> DataFrame:
    return df.where(F.col("video_transcript").isNull() | (F.col("video_transcript") == sentinel))
