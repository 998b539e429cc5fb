"""Conversations as training rows: prefixes, stops, and values carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.ranking import free_names, joined


def _before(conv: str, order: str):
    return Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def take_while_good(df: DataFrame, bad: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The turns of each conversation before its first bad one."""
    (first,) = free_names(df, "first")
    found = F.min(F.when(bad, F.col(turn))).over(Window.partitionBy(conv))
    return df.withColumn(first, found).where(F.col(first).isNull() | (F.col(turn) < F.col(first))).drop(first)


def without_first(df: DataFrame, counted: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Without the first turn of each conversation for which `counted` holds."""
    (name,) = free_names(df, "n")
    own = Window.partitionBy(conv).orderBy(turn)
    n = F.sum(F.when(counted, 1).otherwise(0)).over(own)
    return df.withColumn(name, n).where(~(counted & (F.col(name) == 1))).drop(name)


def with_prefix(df: DataFrame, item: Column, conv: str = "conv_id", turn: str = "turn", spread: Column | None = None) -> DataFrame:
    """Add prompt: the items of all turns before a row's own, empty for the first.

    spread: a bucket that follows the turn; a long conversation is then scanned bucket by bucket, each bucket's items
    standing before the next one's. Prefixes themselves take space in the square of a conversation's length."""
    if spread is None:
        return df.withColumn("prompt", F.collect_list(item).over(_before(conv, turn)))
    b, mine, before = free_names(df, "bucket", "mine", "before")
    rows = df.withColumn(b, spread).withColumn(mine, item)
    within = Window.partitionBy(conv, b).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(mine).alias("item")))), lambda x: x["item"])
    along = Window.partitionBy(conv).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(conv, b).agg(items.alias(mine)).select(conv, b, F.flatten(F.collect_list(mine).over(along)).alias(before))
    out = joined(rows.withColumn("prompt", F.collect_list(mine).over(within)), summary, [conv, b])
    return out.withColumn("prompt", F.concat(F.col(before), F.col("prompt"))).drop(b, mine, before)


def carried_last(df: DataFrame, value: Column, where: Column, out: str, conv: str = "conv_id", turn: str = "turn", spread: Column | None = None) -> DataFrame:
    """Add the value at the latest row before for which `where` holds, be it null; spread as for with_prefix."""
    if spread is None:
        latest = F.max_by(value, F.when(where, F.col(turn))).over(_before(conv, turn))
        return df.withColumn(out, latest)
    b, found, before = free_names(df, "bucket", "found", "before")
    rows = df.withColumn(b, spread).withColumn(found, F.when(where, F.struct(F.col(turn).alias("turn"), value.alias("value"))))
    within = Window.partitionBy(conv, b).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(conv).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.col(found), F.col(f"{found}.turn"))
    summary = rows.groupBy(conv, b).agg(last.alias(found)).select(conv, b, F.last(found, ignorenulls=True).over(along).alias(before))
    near = joined(rows.withColumn(out, last.over(within)), summary, [conv, b])
    return near.withColumn(out, F.coalesce(F.col(out), F.col(before))["value"]).drop(b, found, before)


def first_value(df: DataFrame, value: Column, where: Column, conv: str = "conv_id", turn: str = "turn", default: str = "unknown_user", out: str = "user_id") -> DataFrame:
    """One row a conversation: the first value, in order of turns, for which `where` holds, else a default."""
    return df.groupBy(conv).agg(F.coalesce(F.min_by(value, F.when(where, F.col(turn))), F.lit(default)).alias(out))


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One training row for each user turn after the first: prompt, completion and turn_id (turns before it).

    System turns are left out first. `df` has role and text."""
    spoken = df.where(F.col("role") != "system")
    numbered = with_prefix(spoken, F.struct("role", F.col("text").alias("content")), conv, turn).withColumn("turn_id", F.size("prompt"))
    return numbered.where((F.col("role") == "user") & (F.col("turn_id") > 0)).select(conv, turn, "prompt", F.col("text").alias("completion"), "turn_id")
