"""Listings, completeness and stage caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.storage import exists

SORTS = {"new": ["created"], "top": ["score", "created"], "controversial": ["comments", "created"], "hot": ["heat", "created"], "rising": ["rate", "created"]}
PERIODS = {"hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400, "all": None}


def listing(posts: DataFrame, sort: str, period: str, now: int, n: int, key: str = "id") -> DataFrame:
    """The first n posts (id, created, score, comments) by a sort within a period before `now`."""
    age = F.greatest(F.lit(now) - F.col("created"), F.lit(1))
    rows = posts.where(F.col("created") <= now) if PERIODS[period] is None else posts.where(age <= PERIODS[period])
    rows = rows.withColumn("heat", F.signum("score") * F.log10(F.greatest(F.abs("score"), F.lit(1))) + F.col("created") / 45000).withColumn("rate", F.col("score") / age)
    return top_rows(rows, [*[F.col(c).desc() for c in SORTS[sort]], F.col(key)], n).drop("heat", "rate")


def top_rows(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of an order; each task keeps n at most, so nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(n)


def incomplete(expected: DataFrame, have: DataFrame, key: str, count: str = "items") -> DataFrame:
    """Keys that have fewer rows than expected (key, items): key, items, have."""
    found = have.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return expected.join(found, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < F.col(count))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage read from its folder, built and written there first if it is missing."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reply_chains(mails: DataFrame) -> DataFrame:
    """Files (messages array) of which any message is a reply."""
    return mails.where(F.exists("messages", lambda m: m["is_reply"]))


def named_lists(lists: DataFrame, names: list[str] | None, title: str = "title") -> DataFrame:
    """Playlists with one of the names; all of them without a list of names."""
    return lists if names is None else lists.where(F.col(title).isin(names))


def known_categories(rows: DataFrame, category: str = "category") -> DataFrame:
    """Without the category `Unknown`, whose data are not whole."""
    return rows.where(~F.col(category).eqNullSafe("Unknown"))


def top_level(comments: DataFrame, only: bool, parent: str = "parent_id") -> DataFrame:
    """With `only`, comments that answer no other."""
    return comments.where(F.coalesce(F.col(parent), F.lit("")) == "") if only else comments


def parse_stats(mails: DataFrame) -> DataFrame:
    """Totals of parsed files (messages array): files, with nested messages, with a reply, most nested."""
    n = F.size("messages") - 1
    return mails.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(n > 0).alias("nested"), F.count_if(F.exists("messages", lambda m: m["is_reply"])).alias("replies"), F.coalesce(F.max(n), F.lit(0)).alias("most_nested")
    )
