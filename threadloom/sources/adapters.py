"""The driver's tables as interaction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, post_id (type and day), timestamp, props."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.concat_ws("-", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("post_id"),
        seconds("ts").alias("timestamp"), "event_type", "value", "props",
    )


EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type || '-' || strftime(ts, '%Y-%m-%d') AS post_id, floor(epoch(ts))::BIGINT AS timestamp, event_type, value, props FROM events)"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as posts (parts) and users (customers): user_id, post_id, timestamp, and what tells rows apart."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("post_id"), seconds("l_shipdate").alias("timestamp"), "l_extendedprice", "l_quantity"
    )
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")


PURCHASES_SQL = """l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS post_id, floor(epoch(l_shipdate))::BIGINT AS timestamp,
  l_extendedprice, l_quantity, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LINE_KEY = ["l_orderkey", "l_linenumber", "post_id", "l_suppkey", "l_extendedprice"]
LINE_KEY_SQL = "l_orderkey, l_linenumber, post_id, l_suppkey, l_extendedprice"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken turns numbered from 0 without the system's: conv_id, turn, role, text, k."""
    from pyspark.sql.window import Window

    df = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return df.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
