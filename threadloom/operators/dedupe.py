"""One row a key, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.ranking import free_names


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    (rn,) = free_names(df, "rn")
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) == 1).drop(rn)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def two_keys(df: DataFrame, first: Column, second: Column, order: list[str]) -> DataFrame:
    """First by one key where it is not empty, then by the other; a row dropped by the first does not count for the second."""
    k1, k2 = free_names(df, "first key", "second key")
    df = df.withColumn(k1, F.coalesce(first, F.lit(""))).withColumn(k2, second)
    named = first_per_key(df.where(F.col(k1) != ""), [k1], [F.col(c) for c in order])
    return first_per_key(named.unionByName(df.where(F.col(k1) == "")), [k2], [F.col(c) for c in order]).drop(k1, k2)


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both, the new row where a key is in each; keys are unique within either."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` whose keys `old` lacks; several new rows of one key all pass."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")
