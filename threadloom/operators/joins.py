"""Joins of interactions with items, transcripts and personas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.dedupe import last_per_key


def last_item_wins(rows: DataFrame, items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Inner join with the last of each key's items; rows without an item are dropped."""
    return rows.join(last_per_key(items, keys, order), keys)


def without_item(rows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose item is missing; an assertion where there must be none."""
    return rows.join(items.select(*keys), keys, "left_anti")


def with_default(rows: DataFrame, side: DataFrame, keys: list[str], **defaults) -> DataFrame:
    """Left join with a value for what is missing."""
    out = rows.join(side, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def rejoin(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a composite key; rows multiply where the side has a key more than once."""
    return rows.join(side, keys, "left")


def bundle(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with a struct of each part (null where it lacks the key); keys are unique within a part."""
    out = None
    for name, df in parts.items():
        side = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
        out = side if out is None else out.join(side, key, "full_outer")
    return out
