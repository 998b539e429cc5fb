"""Embedding near-dedup: overlapping cluster shards, a robust-pruned graph of each, one flat graph of their union, range
searches from medoids, an audit of recall, and exact verification.

1. Equal vectors of a label become one node. Groups of a label and a dimension that are larger than MOST_NODES are split
   by centroids of a bounded sample, each node going to its OVERLAP nearest, until all shards are small.
2. Where many of a shard's vectors crowd around one direction, those within BALL of it are a ball: every two of them are
   linked by the triangle inequality, so they are counted and not searched. Only vectors in the fringe of a ball, within
   FRINGE of its centre, are compared with its members, block by block.
3. Each shard's graph is built by itself; a node's neighbours in all its shards are united, so that edges lead from one
   shard into another. A shard is searched with those outside neighbours at hand that are near enough to matter.
4. Cosines that decide are computed in double precision from the vectors as given. A pair that shares shards counts in
   the first of them; pairs that only a border edge found are written and counted once.
5. The links of a bounded sample are counted by brute force. If the graph found less than LEAST_RECALL of them, it is
   built again with more overlap and wider beams."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import flat_graph
from threadloom.llm.common import case_safe, hash_order, hashed_sample, materialize, scratch, small, table, temporary, write_table
from threadloom.llm.near_pairs import components

THRESHOLD = 0.93
#: Nodes of a shard, shards that a node goes to, shards that one is split into at most, and vectors that a split is fitted on.
MOST_NODES, OVERLAP, MOST_PARTS, SAMPLE = 1024, 2, 64, 1024
#: Splits one after the other; each takes a shard apart into MOST_PARTS, so this is room for 64^8 shards.
DEEPEST = 8
#: Vectors of a sample, by share, that make a ball, and balls of a shard.
CROWD, MOST_BALLS = 1 / 32, 16
#: Vectors of the audit, at most so many numbers in them, and the share of their links that the graph must find.
AUDITED, AUDITED_NUMBERS, LEAST_RECALL = 1024, 1 << 20, 0.98
#: Below the threshold by so much, candidates are still expanded and kept at borders.
SLACK, BORDER = 0.02, 0.08
#: Vectors of a block of a ball's members or fringe.
BLOCK = 2048

_NODE = "node long, copies long, vec array<double>"


def ball_cosine(threshold: float) -> float:
    """The cosine of half the threshold's angle, and a little: two vectors as near to a centre are linked."""
    return math.cos(math.acos(threshold) / 2) + 1e-6


def fringe_cosine(threshold: float) -> float:
    """The cosine of one and a half of the threshold's angle: nothing farther from a ball's centre is linked with a member."""
    return math.cos(math.acos(threshold) * 1.5) - 1e-6


def units_of(vectors: pd.Series) -> np.ndarray:
    """Unit vectors, in double precision; scaled first, so that no square overflows or vanishes."""
    raw = np.stack(vectors.to_numpy())
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def usable(vec: Column) -> Column:
    """Whether a vector is not null, holds only finite numbers, and is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


# ---------------------------------------------------------------- shards and balls


def fitted(units: np.ndarray, parts: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(balls, centroids) of a sample: centres that many of it crowd around, and centroids of what is left.

    Centroids of one crowd are united, so that a split does not part it."""
    held, balls, radius = np.zeros(len(units), bool), [], ball_cosine(threshold)
    likes = units @ units.T
    while len(balls) < MOST_BALLS:
        crowd = ((likes >= threshold) & ~held).sum(axis=1) * ~held
        at = int(crowd.argmax())
        if crowd[at] < max(8, CROWD * len(units)):
            break
        centre = units[(likes[at] >= threshold) & ~held].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = (units @ centre >= radius) & ~held
        if inside.sum() < max(8, CROWD * len(units)):
            break  # too loose for a ball
        balls.append(centre)
        held |= inside
    rest = units[~held]
    if len(rest) <= 1:
        return np.array(balls), rest
    centroids = rest[:: max(1, len(rest) // parts)][:parts]
    for _ in range(8):
        nearest = (rest @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rest)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    apart: list[np.ndarray] = []
    for c in centroids:
        if all(c @ x < 2 * threshold * threshold - 1 for x in apart):  # by twice the threshold's angle
            apart.append(c)
    return np.array(balls), np.array(apart)


def split(nodes: DataFrame, name: str, overlap: int, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(leaves, crowds) of `nodes` (node, copies, vec, shard), both written: shards of at most `most` nodes, and balls.

    leaves: node, copies, vec, shard. crowds: ball, node, copies, vec, inside (or in the fringe). A shard that centroids
    cannot part into halves, or that is still too large after DEEPEST splits, is dealt into blocks, and every two of its
    blocks are a shard, so that none of its pairs is lost."""
    state, depth = nodes, 0
    leaves, crowds = [], []
    inner, outer = ball_cosine(threshold), fringe_cosine(threshold)
    while True:
        sizes = materialize(state.groupBy("shard").agg(F.count(F.lit(1)).alias("size")), f"{name}-sizes")
        large = sizes.where(F.col("size") > most)
        if large.isEmpty():
            leaves.append(state)
            break
        leaves.append(state.join(small(large), "shard", "left_anti"))
        state = state.join(small(large), "shard")
        few = hashed_sample(state.select("shard", "size", "node"), SAMPLE, ["node"], "shard").join(state.select("shard", "node", "vec"), ["shard", "node"])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            size = int(pdf["size"].iloc[0])
            units = units_of(pdf.sort_values("node")["vec"])
            balls, centroids = fitted(units, min(MOST_PARTS, -(-2 * overlap * size // most)), threshold)
            # a split must at least halve its shards, or rows would multiply level by level
            free = units[(units @ balls.T).max(axis=1) < inner] if len(balls) else units
            parted = len(centroids) > overlap and len(free) and np.bincount(np.argsort(-(free @ centroids.T), axis=1, kind="stable")[:, :overlap].ravel()).max() <= len(free) / 2
            blocks = 0 if parted and depth < DEEPEST else -(-2 * size // most)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "balls": [[x.tolist() for x in balls]], "centroids": [[x.tolist() for x in centroids]], "blocks": [blocks]})

        plans = materialize(few.groupBy("shard").applyInPandas(fit, "shard string, balls array<array<double>>, centroids array<array<double>>, blocks int"), f"{name}-plans")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for shard, pdf in whole.groupby("shard", sort=False):
                    units, plan, n = units_of(pdf["vec"]), pdf.iloc[0], len(pdf)
                    own = np.full(n, -1)
                    rows = []
                    if len(plan["balls"]):
                        near = units @ np.stack(plan["balls"]).T
                        own = np.where(near.max(axis=1) >= inner, near.argmax(axis=1), -1)
                        for b in range(near.shape[1]):
                            # of two balls' members, the later ball's are in the earlier one's fringe
                            for inside, at in ((True, own == b), (False, (near[:, b] >= outer) & ((own < 0) | (own > b)))):
                                rows.append(pdf[at].assign(kind="inside" if inside else "fringe", place=f"{shard}@{b}"))
                    free = np.nonzero(own < 0)[0]
                    if plan["blocks"]:
                        block = pdf["node"].to_numpy()[free] % plan["blocks"]
                        for other in range(plan["blocks"]):
                            rows.append(pdf.iloc[free].assign(kind="final", place=[f"{shard}|{min(x, other)}|{max(x, other)}" for x in block]))
                    elif len(free):
                        order = np.argsort(-(units[free] @ np.stack(plan["centroids"]).T), axis=1, kind="stable")[:, :overlap]
                        for k in range(order.shape[1]):
                            rows.append(pdf.iloc[free].assign(kind="shard", place=[f"{shard}/{x}" for x in order[:, k]]))
                    if rows:
                        yield pd.concat(rows)[["kind", "place", "node", "copies", "vec"]]

        placed = materialize(state.drop("size").join(small(plans), "shard").mapInPandas(assign, f"kind string, place string, {_NODE}"), f"{name}-placed")
        crowds.append(placed.where("kind IN ('inside', 'fringe')").select(F.col("place").alias("ball"), "node", "copies", "vec", (F.col("kind") == "inside").alias("inside")))
        leaves.append(placed.where("kind = 'final'").select("node", "copies", "vec", F.col("place").alias("shard")))
        depth += 1
        state = placed.where("kind = 'shard'").select("node", "copies", "vec", F.col("place").alias("shard"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    columns = ["node", "copies", "vec", "shard"]
    leaf = materialize(union([x.select(*columns) for x in leaves]), f"{name}-leaves")
    crowd = union(crowds) if crowds else nodes.where(F.lit(False)).select(F.col("shard").alias("ball"), "node", "copies", "vec", F.lit(True).alias("inside"))
    return leaf, crowd


def crowd_links(crowds: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of balls: node and links for every member and fringe vector, and (a, b) edges that connect them.

    A ball's members are linked with each other without comparison; members and fringe meet in pairs of blocks."""
    balls = materialize(
        crowds.groupBy("ball").agg(
            F.min(F.when(F.col("inside"), F.col("node"))).alias("head"), F.sum(F.when(F.col("inside"), F.col("copies"))).alias("weight"),
            F.ceil(F.count_if("inside") / BLOCK).alias("blocks"), F.ceil(F.count_if(~F.col("inside")) / BLOCK).alias("outer"),
        ).where("head IS NOT NULL"), "balls",
    )
    held = crowds.join(small(balls), "ball")
    members = held.where("inside").select("node", (F.col("weight") - F.col("copies")).alias("links"), "head")
    i = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    inside = held.where("inside AND outer > 0").select("ball", "inside", "node", "copies", "vec", i(F.col("blocks")).alias("i"), every(F.col("outer")).alias("j"))
    fringe = held.where("NOT inside").select("ball", "inside", "node", "copies", "vec", every(F.col("blocks")).alias("i"), i(F.col("outer")).alias("j"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["inside"]].reset_index(drop=True), pdf[~pdf["inside"]].reset_index(drop=True)
        out = [pd.DataFrame({"node": [], "links": [], "head": []})]
        if len(a) and len(b):
            other = units_of(b["vec"])
            total, first = np.zeros(len(b), np.int64), np.full(len(b), -1)
            for at in range(0, len(a), 256):
                part = a.iloc[at : at + 256]
                hit = units_of(part["vec"]) @ other.T >= threshold
                out.append(pd.DataFrame({"node": part["node"], "links": hit @ b["copies"].to_numpy(), "head": part["node"]}))
                total += part["copies"].to_numpy() @ hit
                first = np.where(hit.any(axis=0) & (first < 0), part["node"].to_numpy()[hit.argmax(axis=0)], first)
            out.append(pd.DataFrame({"node": b["node"], "links": total, "head": np.where(first < 0, b["node"], first)}))
        found = pd.concat(out)
        return found[found["links"] > 0].astype("int64")

    met = materialize(inside.unionByName(fringe).groupBy("ball", "i", "j").applyInPandas(meet, "node long, links long, head long"), "met")
    found = materialize(members.unionByName(met), "crowd-links")
    return found.select("node", "links"), found.select(F.col("head").alias("a"), F.col("node").alias("b"))


# ---------------------------------------------------------------- the graph


def neighbours(leaves: DataFrame, beam: int) -> DataFrame:
    """(node, ids, likes): each node's neighbours in the graphs of all its shards, united."""

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")  # the graph does not depend on how rows came
        units, ids = units_of(pdf["vec"]).astype(np.float32), pdf["node"].to_numpy()
        adjacent = flat_graph.build(units, beam)
        rows = [x[x >= 0] for x in adjacent]
        return pd.DataFrame({"node": ids, "ids": [ids[x] for x in rows], "likes": [(units[x] @ units[k]).astype(np.float64) for k, x in enumerate(rows)]})

    built = leaves.select("shard", "node", "vec").groupBy("shard").applyInPandas(graph, "node long, ids array<long>, likes array<double>")
    edge = F.arrays_zip("ids", "likes")
    united = built.select("node", edge.alias("edges")).groupBy("node").agg(F.array_distinct(F.transform(F.flatten(F.collect_list("edges")), lambda e: F.struct(e["ids"].alias("id"), F.round(e["likes"], 3).alias("like")))).alias("edges"))
    return materialize(united, "graph")


def searched(leaves: DataFrame, beam: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of the range searches of all shards, as crowd_links gives them.

    A shard's task holds its nodes and, of their neighbours in other shards, those within BORDER of the threshold."""
    graph = neighbours(leaves, beam)
    homes = materialize(leaves.groupBy("node").agg(F.array_sort(F.collect_set(F.xxhash64("shard"))).alias("homes")), "homes")
    known = materialize(leaves.select("node", "copies", "vec").dropDuplicates(["node"]).join(homes, "node").join(graph, "node"), "known")
    placed = leaves.select("shard", "node")
    border = graph.select("node", F.explode(F.filter("edges", lambda e: e["like"] >= threshold - BORDER)).alias("e")).select("node", F.col("e.id").alias("to"))
    outside = placed.join(border, "node").select("shard", F.col("to").alias("node")).distinct().join(placed, ["shard", "node"], "left_anti")
    both = placed.withColumn("own", F.lit(True)).unionByName(outside.withColumn("own", F.lit(False)))
    tasks = both.join(known.withColumn("ids", F.transform("edges", lambda e: e["id"])).drop("edges"), "node").withColumn("home", F.xxhash64("shard"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        exact, ids, own, copies = units_of(pdf["vec"]), pdf["node"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
        units, home = exact.astype(np.float32), pdf["home"].iloc[0]
        adjacent = np.full((len(ids), max(map(len, pdf["ids"]), default=0) + 1), -1, np.int32)
        for k, x in enumerate(pdf["ids"]):
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            at = np.unique(at[ids[at] == x])
            adjacent[k, : len(at)] = at
        inner = np.nonzero(own)[0]
        a, b = flat_graph.in_range(units, adjacent, int(inner[flat_graph.medoid(units[inner])]), threshold - SLACK, beam)
        hit = flat_graph.likeness(exact, a, b) >= threshold
        a, b = a[hit], b[hit]
        # pairs of this shard's own whose first common home it is; others that share a home count there
        width = max(map(len, pdf["homes"]))
        homes = np.stack([np.pad(np.asarray(x, object), (0, width - len(x)), constant_values=None) for x in pdf["homes"]])
        first = np.array([next((x for x in homes[i] if x is not None and x in set(homes[j])), None) for i, j in zip(a, b, strict=True)], object) if width > 1 or len(inner) < len(ids) else np.full(len(a), home, object)
        here = np.array([x == home for x in first], bool)
        apart = np.array([x is None for x in first], bool)
        links = np.bincount(a[here], copies[b[here]], len(ids)) + np.bincount(b[here], copies[a[here]], len(ids))
        forest = np.arange(len(ids))
        for i, j in zip(a[here], b[here], strict=True):
            while forest[i] != i:
                forest[i] = i = forest[forest[i]]
            while forest[j] != j:
                forest[j] = j = forest[forest[j]]
            forest[max(i, j)] = min(i, j)
        for k in range(len(ids)):
            forest[k] = forest[forest[k]]
        linked = np.nonzero(links)[0]
        counted = pd.DataFrame({"a": ids[forest[linked]], "b": ids[linked], "links": links[linked].astype(np.int64), "copies_a": 0, "copies_b": 0})
        pairs = pd.DataFrame({"a": ids[a[apart]], "b": ids[b[apart]], "links": -1, "copies_a": copies[a[apart]], "copies_b": copies[b[apart]]})
        return pd.concat([counted, pairs]).astype("int64")

    found = materialize(tasks.groupBy("shard").applyInPandas(find, "a long, b long, links long, copies_a long, copies_b long"), "found")
    pairs = materialize(found.where("links < 0").distinct(), "border-pairs")
    counts = found.where("links > 0").select(F.col("b").alias("node"), "links")
    counts = counts.unionByName(pairs.select(F.col("a").alias("node"), F.col("copies_b").alias("links"))).unionByName(pairs.select(F.col("b").alias("node"), F.col("copies_a").alias("links")))
    return counts, found.select("a", "b")


# ---------------------------------------------------------------- audit and result


def recall(nodes: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, int]:
    """(share, links): of the links of a bounded sample of nodes, counted by brute force, the share that `counts` has, and their number.

    The sample is broadcast: AUDITED vectors of at most AUDITED_NUMBERS numbers."""
    wide = max(1, nodes.agg(F.max(F.size("vec"))).first()[0] or 1)
    chosen = nodes.orderBy(hash_order("node")).select("node", "shard", "vec").limit(max(1, min(AUDITED, AUDITED_NUMBERS // wide))).toPandas()
    if not len(chosen):
        return 1.0, 0
    groups = {g: (units_of(x["vec"]), x["node"].to_numpy()) for g, x in chosen.groupby("shard")}
    shared = nodes.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for g, pdf in whole.groupby("shard"):
                if g in shared.value:
                    units, ids = shared.value[g]
                    for at in range(0, len(pdf), BLOCK):
                        part = pdf.iloc[at : at + BLOCK]
                        hit = (units @ units_of(part["vec"]).T >= threshold) & (ids[:, None] != part["node"].to_numpy())
                        yield pd.DataFrame({"node": ids, "true_links": hit @ part["copies"].to_numpy()})

    true = nodes.mapInPandas(count, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    mine = counts.groupBy("node").agg(F.sum("links").alias("links"))
    met, total = true.join(mine, "node", "left").agg(F.sum(F.least("true_links", F.coalesce("links", F.lit(0)))), F.sum("true_links")).first()
    return (met or 0) / max(1, total or 0) if total else 1.0, total or 0


@case_safe()
def near(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, most: int = MOST_NODES, tries: int = 3) -> DataFrame:
    """Vectors of `vectors` (vec_id, embedding, label) with their links to others of the same label: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine, in double precision, is `threshold` or more; component_id is the least vec_id
    within reach. Vectors that are null, empty, zero, or hold null or non-finite components, and those of a null label,
    link with nothing; vectors of different dimensions do not link; equal vectors and repeated rows link with each
    other, a row each; a null vec_id counts as the greatest, and as kept only if all its component's are null; an empty
    table gives no rows; other columns are ignored. A few links may be missed (see LEAST_RECALL); none is made up."""
    spark = vectors.sparkSession
    result = scratch(spark, "near-vectors")
    with temporary(spark):
        vec = F.col("embedding").cast("array<double>")
        rows = vectors.select("vec_id", "label", F.when(usable(vec) & F.col("label").isNotNull(), vec).alias("vec"))
        group = F.concat(F.col("label").cast("string"), F.lit("x"), F.size("vec").cast("string"))
        keyed = materialize(rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.struct(group.alias("g"), F.xxhash64("vec").alias("x"), F.xxhash64(F.lit("more"), "vec").alias("y"))).alias("key"), "vec"), "rows")
        nodes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("head"), F.any_value("vec").alias("vec"))
        nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        slim = nodes.select("node", "copies", "vec", F.col("key.g").alias("shard"))
        beam = flat_graph.BEAM
        for k in range(tries):
            leaves, crowds = split(slim, f"try{k}", overlap, most, threshold)
            (crowd_counts, crowd_edges), (counts, edges) = crowd_links(crowds, threshold), searched(leaves, beam, threshold)
            counts = materialize(counts.unionByName(crowd_counts).groupBy("node").agg(F.sum("links").alias("links")), "counts")
            share, links = recall(slim, counts, threshold)
            if share >= LEAST_RECALL:
                break
            overlap, beam = 2 * overlap, 2 * beam
        else:
            warnings.warn(f"recall of {share:.3f} on {links} audited links", stacklevel=2)
        joined = components(edges.unionByName(crowd_edges)).withColumnRenamed("v", "node")
        about = nodes.select("key", "node", "copies", "head").join(counts, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = about.groupBy("root").agg(F.min("head").alias("component_id"))
        about = about.join(heads, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        alone = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = keyed.select("vec_id", "key").join(about, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
        return write_table(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
    SELECT id, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
    SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.id <> b.id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}
), r AS (
    SELECT id AS a, id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
    SELECT a, min(vec_id) AS component_id FROM r JOIN v ON v.id = r.b GROUP BY a
), n AS (
    SELECT a, count(*) AS links FROM p GROUP BY a
)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON v.id = c.a LEFT JOIN n ON v.id = n.a
"""
