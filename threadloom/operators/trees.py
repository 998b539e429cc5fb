"""Comment trees and response graphs, flattened by doubling the paths to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.storage import fresh_path, remove, stored


def _walked(nodes: DataFrame, keep: Column | None) -> DataFrame:
    """(node_id, path): every node that hangs from a root, with the ids from the root down to it.

    Each open node holds the ids below some ancestor, and that ancestor as `up`. A round puts the ancestor's own ids
    before them, so paths double: a tree of depth d takes log2(d) joins, and depth and rows have no limit. A node whose
    path has reached its root is finished: it is written once and read by later rounds, never again rewritten. Nodes
    whose ancestor is missing fall out, and so do steps that would pass a node again."""
    spark = nodes.sparkSession
    kept = nodes if keep is None else nodes.where(keep)
    state = kept.select(F.col("node_id").cast("string").alias("node_id"), F.col("parent_id").cast("string").alias("up"), F.array(F.col("node_id").cast("string")).alias("path"))
    path = fresh_path(spark, "tree")
    state = stored(state, path)
    finished = [stored(state.where(F.col("up").isNull()).drop("up"), fresh_path(spark, "tree"))]
    open_ = state.where(F.col("up").isNotNull())
    while not open_.isEmpty():
        above = open_.select(F.col("node_id").alias("at"), F.col("up").alias("next"), F.col("path").alias("before"))
        for part in finished:
            above = above.unionByName(part.select(F.col("node_id").alias("at"), F.lit(None).cast("string").alias("next"), F.col("path").alias("before")))
        longer = open_.join(above, F.col("up") == F.col("at")).where(~F.arrays_overlap("before", "path"))
        last, path = path, fresh_path(spark, "tree")
        state = stored(longer.select("node_id", F.col("next").alias("up"), F.concat("before", "path").alias("path")), path)
        remove(spark, last)
        finished.append(stored(state.where(F.col("up").isNull()).drop("up"), fresh_path(spark, "tree")))
        open_ = state.where(F.col("up").isNotNull())
    remove(spark, path)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def flatten(nodes: DataFrame, keep: Column | None = None) -> DataFrame:
    """Every node that hangs from a root: node_id, depth (from 0), path (ids from the root).

    `nodes` has node_id, parent_id (null at a root). Nodes for which `keep` fails are pruned with all below them. A
    node that comes up again on its own path ends there, so cycles end."""
    return _walked(nodes, keep).select("node_id", (F.size("path") - 1).alias("depth"), "path")


def tops_and_replies(comments: DataFrame) -> DataFrame:
    """Comments (id, text, replies array<struct<id,text>>) as rows, each reply with its top comment above it."""
    top = comments.select("id", "text", F.array().cast("array<string>").alias("upper_comments"))
    replies = comments.select(F.col("id").alias("top"), F.explode("replies").alias("r"))
    return top.unionByName(replies.select(F.col("r.id").alias("id"), F.col("r.text").alias("text"), F.array("top").alias("upper_comments")))


def edges_of(nodes: DataFrame, node: str = "id", children: str = "responses") -> DataFrame:
    """Child ids in arrays as (parent_id, node_id, ord)."""
    return nodes.select(F.col(node).alias("parent_id"), F.posexplode(children).alias("ord", "node_id"))


def with_ancestors(nodes: DataFrame, keep: Column | None = None) -> DataFrame:
    """flatten, with the items of a node's ancestors from its root down: node_id, depth, path, above.

    `nodes` also has a column item of any type; a root's `above` is empty. Paths are of ids; items are joined to them at
    the end, once."""
    flat = stored(flatten(nodes, keep).distinct(), fresh_path(nodes.sparkSession, "paths"))
    # a node with several parents has several paths, and comes several times among the nodes
    steps = flat.select("path", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "id"))
    items = nodes.select(F.col("node_id").cast("string").alias("id"), "item").dropDuplicates(["id"])
    listed = steps.join(items, "id").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("above"))
    kind = f"array<{nodes.schema['item'].dataType.simpleString()}>"
    return flat.join(listed, "path", "left").select("node_id", "depth", "path", "above").withColumn("above", F.coalesce("above", F.array().cast(kind)))
