"""Threads by gaps in time, and their reply rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import strip
from threadloom.operators.dedupe import union_all
from threadloom.operators.ranking import free_names, joined
from threadloom.storage import fresh_path, stored

WEEK = 7 * 86400


def gap_sessions(df: DataFrame, gap: int, keys: list[str], time: str, order: list[str], spread: Column | None = None) -> DataFrame:
    """Add thread_no (from 1): a new thread begins where the time since the row before exceeds `gap` seconds.

    spread: a bucket that follows the time, such as its day. Rows are then scanned bucket by bucket: each bucket's first
    and last time and number of breaks are summed along a key's buckets and added to what its own rows count, so that
    no task holds more than a bucket of a key, however many rows it has."""
    fresh, b, first, last, breaks, before = free_names(df, "fresh", "bucket", "first", "last", "breaks", "before")
    df = df if spread is None else df.withColumn(b, spread)
    parts = keys if spread is None else [*keys, b]
    own = Window.partitionBy(*parts).orderBy(time, *order)
    broken = F.when(F.col(time) - F.lag(time).over(own) > gap, 1).otherwise(0)
    rows = df.withColumn(fresh, broken)
    running = F.sum(fresh).over(own.rowsBetween(Window.unboundedPreceding, 0))
    if spread is None:
        return rows.withColumn("thread_no", running + 1).drop(fresh)
    along = Window.partitionBy(*keys).orderBy(b)
    summary = rows.groupBy(*parts).agg(F.min(time).alias(first), F.max(time).alias(last), F.sum(fresh).alias(breaks))
    edge = F.when(F.col(first) - F.max(last).over(along.rowsBetween(Window.unboundedPreceding, -1)) > gap, 1).otherwise(0)
    summary = summary.withColumn(fresh, edge)
    carried = F.sum(F.col(fresh)).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(breaks).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = summary.select(*parts, carried.alias(before))
    return joined(rows.withColumn("thread_no", running), summary, parts).withColumn("thread_no", F.col("thread_no") + F.col(before) + 1).drop(fresh, before, b)


def thread_ids(df: DataFrame, keys: list[str], time: str, order: list[str], parts: list[str], prefix: str = "thread_") -> DataFrame:
    """Add thread_id: an md5 of the thread's key and its first row, 16 digits. `df` has thread_no."""
    own = Window.partitionBy(*keys, "thread_no").orderBy(time, *order)
    return df.withColumn("thread_id", F.concat(F.lit(prefix), F.substring(F.md5(_head(keys, parts, own)), 1, 16)))


def _head(keys: list[str], parts: list[str], own) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], *[F.first(F.col(p).cast("string")).over(own) for p in parts])


def unique_thread_ids(df: DataFrame, keys: list[str], time: str, order: list[str], parts: list[str], prefix: str = "thread_", digits: int = 16) -> DataFrame:
    """thread_ids with one id a thread: where heads have one id, all but the least are hashed again with `|alt` behind them, to an id one digit longer.

    Ids of another length never meet, so a round compares only the heads that the one before left over, and more threads
    than `digits` can tell apart find room after a few rounds. Only heads are compared, one row a thread. A thread whose
    rows differ in nothing of its key and first row has the id of its equal."""
    own = Window.partitionBy(*keys, "thread_no").orderBy(time, *order)
    head, seed, rank = free_names(df, "head", "seed", "rank")
    rows = df.withColumn(head, _head(keys, parts, own))
    spark = df.sparkSession
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy(head))
    left, named = rows.select(head).distinct().withColumn(seed, F.col(head)), []
    while True:
        # behind md5's 32 digits come those of another hash
        hashed = F.md5(seed) if digits <= 32 else F.concat(F.md5(seed), F.sha2(seed, 256))
        met = left.withColumn("thread_id", F.substring(hashed, 1, digits)).withColumn(rank, place)
        met = stored(met, fresh_path(spark, "heads"))
        named.append(met.where(F.col(rank) == 1).select(head, F.concat(F.lit(prefix), "thread_id").alias("thread_id")))
        left = met.where(F.col(rank) > 1).select(head, F.concat(seed, F.lit("|alt")).alias(seed))
        if left.isEmpty():
            break
        digits += 1
    return rows.join(union_all(*named), head).drop(head)


def reply_examples(df: DataFrame, order: list[str], least: int = 2, shortest: int = 10, thread: str = "thread_id") -> DataFrame:
    """Rows (prompt, completion, ...) of threads with `least` mails: each mail after the first, answering all before it.

    `df` has user_id, body, timestamp. Bodies shorter than `shortest` and ones that repeat the last of the prompt are
    left out; they stay in later prompts."""
    own = Window.partitionBy(thread)
    by_time = own.orderBy(*order)
    about = F.col("metadata") if "metadata" in df.columns else F.lit("{}")
    item = F.struct(F.col("user_id").alias("role"), F.col("body").alias("content"), about.alias("metadata"))
    (n,) = free_names(df, "n")
    rows = df.withColumn(n, F.count(F.lit(1)).over(own)).where(F.col(n) >= least)
    rows = rows.withColumn("prompt", F.collect_list(item).over(by_time.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where((F.size("prompt") > 0) & (F.length(strip(F.col("body"))) >= shortest))
    return rows.where(strip(F.element_at("prompt", -1)["content"]) != strip(F.col("body"))).withColumnRenamed("body", "completion").drop(n)
