"""Per-user histories: the first rows by time, the rest, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import word_truncate
from threadloom.functions.timeparse import readable_time
from threadloom.operators.ranking import free_names, global_index


def ranked(df: DataFrame, order: list[str], user: str = "user_id", out: str = "rn", spread: Column | None = None) -> DataFrame:
    """Row numbers (from 1) of each user's rows by `order`.

    spread: a bucket that follows the order, such as the day; a user with a large part of all rows is then ranked
    bucket by bucket in many tasks, at the price of a count beforehand."""
    if spread is not None:
        (total,) = free_names(df, "n")
        return global_index(df, spread, [F.col(c) for c in order], out, [user], total).drop(total)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(user).orderBy(*order)))


def first_rows(df: DataFrame, length: int, order: list[str], user: str = "user_id") -> DataFrame:
    """The first `length` rows of each user; the limit reaches below the shuffle."""
    return ranked(df, order, user).where(F.col("rn") <= length)


def later_rows(df: DataFrame, length: int, order: list[str], user: str = "user_id", spread: Column | None = None) -> DataFrame:
    """All but the first `length` rows of each user; users with no more have none."""
    return ranked(df, order, user, spread=spread).where(F.col("rn") > length)


def history_text(df: DataFrame, length: int, order: list[str], text: str = "completion", words: int = 0, longest: int = 0, user: str = "user_id") -> DataFrame:
    """One text a user: its first `length` rows, each as a dated entry.

    words: cut texts after so many words (0: whole); longest: leave out texts with more words (0: none)."""
    rows = df if longest <= 0 else df.where(F.size(F.split(F.trim(F.col(text)), "\\s+")) <= longest)
    body = word_truncate(F.col(text), words) if words > 0 else F.col(text)
    entry = F.concat(F.lit("["), readable_time(F.col("timestamp")), F.lit("] "), body)
    rows = first_rows(rows, length, order, user).select(user, "rn", entry.alias("entry"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry"))), lambda x: x["entry"]), "\n")
    return rows.groupBy(user).agg(F.count(F.lit(1)).alias("entries"), joined.alias("history"))
