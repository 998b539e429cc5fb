"""User activity: counts, bounds, summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_counts(df: DataFrame, user: str = "user_id") -> DataFrame:
    return df.groupBy(user).agg(F.count(F.lit(1)).alias("count"))


def counts_of_sources(sources: list[DataFrame], user: str = "user_id") -> DataFrame:
    """Counts per user over several sources, reading their user column only."""
    union = sources[0].select(user)
    for s in sources[1:]:
        union = union.unionByName(s.select(user))
    return user_counts(union, user)


def active_users(df: DataFrame, least: int, most: int, user: str = "user_id") -> DataFrame:
    """Users with least <= count <= most."""
    return user_counts(df, user).where(F.col("count").between(least, most)).select(user)


def active_rows(df: DataFrame, least: int, most: int, user: str = "user_id", predicate: Column | None = None) -> DataFrame:
    """Rows of active users; `predicate` is a dataset's own row filter, applied after."""
    kept = df.join(active_users(df, least, most, user), user, "left_semi")
    return kept if predicate is None else kept.where(predicate)


def users_below(df: DataFrame, cap: int, user: str = "user_id") -> DataFrame:
    return user_counts(df, user).where(F.col("count") < cap).select(user)


def count_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("users"), F.avg("count").alias("avg_count"), F.min("count").alias("min_count"), F.max("count").alias("max_count"))


def bucket_edges(low: int, high: int, top: int = 10_000) -> list[int]:
    """Ten buckets' edges: five whole steps to the least count, five from it to the greatest, and a last far edge."""
    steps = lambda a, b: [a + int((b - a) * i / 4) for i in range(5)]
    return [*steps(0, low), *steps(low, high), top]


def count_histogram(counts: DataFrame) -> DataFrame:
    """Users by count bucket: half-open buckets, the last closed; the first that fits wins, empty ones are absent."""
    low, high = counts.agg(F.min("count"), F.max("count")).first()  # two numbers
    edges = bucket_edges(low or 0, high or 0)
    place = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        c, last = F.col("count"), i == len(edges) - 2
        place = F.when((c >= edges[i]) & ((c <= edges[i + 1]) if last else (c < edges[i + 1])), i).otherwise(place)
    name = F.element_at(F.array(*[F.lit(f"{a}-{b}") for a, b in zip(edges[:-1], edges[1:], strict=True)]), F.col("bucket_idx") + 1)
    return counts.withColumn("bucket_idx", place).where("bucket_idx IS NOT NULL").groupBy("bucket_idx").agg(F.count(F.lit(1)).alias("users")).withColumn("bucket", name)


def history_drop_stats(counts: DataFrame, length: int) -> DataFrame:
    """Users whose rows all fit a history of `length`, and rows that histories take; zeros for no history."""
    if length <= 0:
        return counts.agg(F.lit(0).cast("long").alias("users_dropped"), F.lit(0).cast("long").alias("rows_dropped"))
    return counts.agg(F.count_if(F.col("count") <= length).alias("users_dropped"), F.coalesce(F.sum(F.least(F.col("count"), F.lit(length))), F.lit(0)).alias("rows_dropped"))


def distinct_counts(df: DataFrame, user: str = "user_id", post: str = "post_id") -> DataFrame:
    return df.agg(F.countDistinct(user).alias("n_users"), F.countDistinct(post).alias("n_posts"))
