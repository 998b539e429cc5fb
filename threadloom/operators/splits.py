"""Leakage-aware splits by user, by post time and by turn, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.ranking import free_names, hash_index, hash_labelled, labelled
from threadloom.storage import fresh_path, stored


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def sample_rows(df: DataFrame, fraction: float, seed: int, keys: list[str]) -> DataFrame:
    """Exactly floor(n * fraction) rows, those with the smallest seeded hashes of `keys`."""
    (kept,) = free_names(df, "kept")
    return hash_labelled(df, seed, keys, lambda rank, n: rank <= F.floor(n * F.lit(float(fraction))), kept).where(kept).drop(kept)


def sample_users(df: DataFrame, fraction: float, seed: int, user: str = "user_id") -> DataFrame:
    return sample_rows(df.select(user).distinct(), fraction, seed, [user])


def split_by_user(df: DataFrame, unseen: float, seen: float, val: float, seed: int, order: list[str], key: list[str], user: str = "user_id") -> DataFrame:
    """Hold out users, then the last rows of the others, then a share of what is left.

    round(users * unseen) users, in seeded order, are unseen_test; of each other user the last round(n * seen) rows by
    time are seen_test; the rest, in seeded order of `key`, is train but for the last round(N * val) rows. All rounding
    is half-even."""
    held, rn, n, part = free_names(df, "held", "rn", "n", "part")
    users = hash_labelled(df.select(user).distinct(), seed, [user], lambda rank, all_: rank <= half_even(all_ * F.lit(float(unseen))), held)
    own = Window.partitionBy(user)
    rows = df.join(users, user).withColumn(rn, F.row_number().over(own.orderBy(*order))).withColumn(n, F.count(F.lit(1)).over(own))
    tail = F.col(rn) > F.col(n) - half_even(F.col(n) * F.lit(float(seen)))
    rows = rows.withColumn(part, F.when(F.col(held), "unseen_test").when(tail, "seen_test")).drop(held, rn, n)
    rows = stored(rows, fresh_path(df.sparkSession, "split"))  # read for counts, for ranks and for the result
    train = lambda rank, all_: F.when(rank <= half_even(all_ * F.lit(1.0 - val)), "train").otherwise("val")
    pool = hash_labelled(rows.where(F.col(part).isNull()).drop(part), seed, key, train, "split")
    return rows.where(F.col(part).isNotNull()).withColumnRenamed(part, "split").unionByName(pool)


def split_by_post_time(df: DataFrame, unseen: float, val: float, post: str = "post_id", time: str = "timestamp") -> DataFrame:
    """Whole posts in order of their first row's time: train, then val, then test, of rounded sizes."""
    def named(rank: Column, n: Column) -> Column:
        n_test, n_val = half_even(n * F.lit(float(unseen))), half_even(n * F.lit(float(val)))
        return F.when(rank <= n - n_test - n_val, "train").when(rank <= n - n_test, "val").otherwise("test")

    starts = post_starts(df, post, time)
    levels = [F.floor(F.col("start") / 86400), F.col("start")]
    return df.join(labelled(starts, levels, [F.col(post)], named, "split").select(post, "split"), post)


def post_starts(df: DataFrame, post: str = "post_id", time: str = "timestamp") -> DataFrame:
    """Each post and the time of its first row, `start`."""
    return df.groupBy(post).agg(F.min(time).alias("start"))


def train_users_only(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Drop val and test rows of users that train does not have."""
    train = df.where(F.col("split") == "train").select(user).distinct()
    return df.where(F.col("split") == "train").unionByName(df.where(F.col("split") != "train").join(train, user, "left_semi"))


def split_by_turn(df: DataFrame, least: int, most: int, unseen: float, val: float, least_train: int, post: str = "post_id", turn: str = "turn_id") -> DataFrame:
    """Within each post, the first turns are train, the next val, all others test, under both test names.

    Posts with a number of distinct turns outside [least, most], or without room for a train turn, are left out."""
    turns = df.select(post, turn).distinct()
    own = Window.partitionBy(post)
    turns = turns.withColumn("k", F.row_number().over(own.orderBy(turn))).withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n").between(least, most))
    n_test = F.ceil(F.col("n") * F.lit(float(unseen))) + 1
    n_val = F.greatest(F.floor(F.col("n") * F.lit(float(val))), F.lit(1)) if val > 0 else F.lit(1)
    n_train = F.greatest(F.lit(least_train), F.col("n") - n_test - n_val)
    names = F.when(F.col("k") <= n_train, F.array(F.lit("train"))).when(F.col("k") <= n_train + n_val, F.array(F.lit("val"))).otherwise(F.array(F.lit("seen_test"), F.lit("unseen_test")))
    named = turns.where(n_train >= 1).select(post, turn, F.explode(names).alias("split"))
    return df.join(named, [post, turn])


def badly_numbered(df: DataFrame, post: str = "post_id", turn: str = "turn_id") -> DataFrame:
    """Posts whose distinct turns are not 2, 4, ..., which a split by turn presumes."""
    return df.select(post, turn).distinct().groupBy(post).agg(F.count(F.lit(1)).alias("n"), F.max(turn).alias("top"), F.count_if(F.col(turn) % 2 != 0).alias("odd")).where("odd > 0 OR top <> 2 * n")


def time_ranges(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.groupBy("split").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows"))


def chunks(df: DataFrame, parts: int, bucket: Column, order: list[Column]) -> DataFrame:
    """Contiguous chunks of floor(n / parts) rows, the remainder in the last: column chunk, from 0."""
    def chunk(rank: Column, n: Column) -> Column:
        return F.least(F.floor((rank - 1) / F.greatest(F.floor(n / parts), F.lit(1))), F.lit(parts - 1)).cast("int")

    return labelled(df, [bucket], order, chunk, "chunk")


def assigned_bucket(df: DataFrame, k: int, seed: int, keys: list[str]) -> DataFrame:
    """Round robin over k buckets in seeded order."""
    rn, n = free_names(df, "rn", "n")
    return hash_index(df, seed, keys, rn, n).withColumn("bucket", F.pmod(F.col(rn) - 1, F.lit(k)).cast("int")).drop(rn, n)


