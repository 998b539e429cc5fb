"""N-gram Jaccard join: MinHash bands find candidates, Bayesian pruning drops them, exact set comparison decides.

1. Each text becomes its set of word shingles; equal sets are one class (copies are never expanded into pairs).
2. Classes that agree in a band of MinHash values meet in a bucket, where pairs are compared a few values at a time and
   dropped once the posterior probability of reaching the threshold falls below the tolerance. A bucket tells only what
   is connected by pairs that survive, a row a class: whoever is connected already is not compared again.
3. What is connected forms a cell. Only there are sets fetched, once; the pairs of a cell that share a band and survive
   are compared exactly, and counted as they are found. No pair is ever stored: links need space by classes alone.

Buckets and cells of any size are dealt out as pairs of blocks, so no task holds a whole group. In a cell of more than
one block a set travels as what it differs by from its cell's first, which for near copies is little."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import textarrays as ta
from threadloom.llm.common import boxed, case_safe, materialize, remove, scratch, sliced, table, temporary, write_table

K, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: MinHash values compared before each look at the posterior, and its least value for a pair to go on. A pair at the
#: threshold is dropped within all looks with probability 2e-7 (missed_share()).
STEP, TOLERANCE = 16, 3e-8
#: Classes of a block, and blocks of a group before they grow to MOST classes, in buckets (where a class is in many) and
#: in cells (where it is in one): tasks stay even while groups are small, and a row of a group of n is copied FEW
#: (CELL_FEW) or n / MOST times at most. Shingles of a cell's block.
BLOCK, FEW, CELL_BLOCK, CELL_FEW, MOST, BLOCK_SHINGLES = 512, 16, 64, 32, 1024, 400_000
#: Bits of a MinHash value that are kept and compared.
VALUE = np.uint16

HASHES = BANDS * ROWS
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, HASHES, np.int64) * 2 + 1).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, HASHES, np.int64).astype(np.uint32)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: K words, or all its words if it has fewer; none without words."""
    for lo, hi in ta.chunks(texts):
        t = ta.Texts(texts[lo:hi])
        h = t.word_hashes()
        g, at = t.grams(h, K)
        of = t.word_text[at]
        cuts = np.searchsorted(of, np.arange(t.n + 1))
        for i in range(t.n):
            if cuts[i] < cuts[i + 1]:
                yield np.unique(g[cuts[i] : cuts[i + 1]])
            else:
                own = h[t.first_word[i] : t.first_word[i + 1]]
                total = np.zeros(1 if len(own) else 0, np.uint64)
                with np.errstate(over="ignore"):
                    for x in own:
                        total = total * ta.PRIME + x
                    yield ta.mix(total + np.uint64(len(own)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set; the lower bits of the least of 32-bit hashes."""
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            np.minimum(low, (x[at : at + 2048, None] * _A + _B).min(0), out=low)
    return low.astype(VALUE)


def band_keys(values: np.ndarray) -> np.ndarray:
    """The 64 bits of each band of a row's values, or of each row's: bands agree if and only if these do."""
    return np.ascontiguousarray(values).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For k = 0 .. HASHES values compared, the matches that a pair needs to go on.

    With a uniform prior, the similarity's posterior after m of k matches is Beta(m + 1, k - m + 1), and its mass at or
    above the threshold is that of at most m successes in k + 1 draws of the threshold's probability."""
    out = []
    for k in range(HASHES + 1):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def missed_share(need: list[int], threshold: float = THRESHOLD) -> float:
    """The probability that a pair at the threshold is dropped at any of the looks."""
    alive = {0: 1.0}
    lost = 0.0
    for k in range(STEP, HASHES + 1, STEP):
        nxt: dict[int, float] = {}
        for m, p in alive.items():
            for x in range(STEP + 1):
                nxt[m + x] = nxt.get(m + x, 0.0) + p * math.comb(STEP, x) * threshold**x * (1 - threshold) ** (STEP - x)
        lost += sum(p for m, p in nxt.items() if m < need[k])
        alive = {m: p for m, p in nxt.items() if m >= need[k]}
    return lost


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p[p] != p).any():
            p = p[p]
        self.parent = p
        return p

    def join(self, i: int, others: np.ndarray) -> None:
        r = self.find(i)
        for j in others:
            s = self.find(int(j))
            if r != s:
                r, s = min(r, s), max(r, s)
                self.parent[s] = r


def surviving(values: np.ndarray, i: int, alive: np.ndarray, need: list[int]) -> np.ndarray:
    """Those of the rows `alive` whose pair with row i survives every look."""
    matches = np.zeros(len(alive), np.int64)
    for k in range(0, HASHES, STEP):
        if not len(alive):
            break
        matches += (values[alive, k : k + STEP] == values[i, k : k + STEP]).sum(1)
        going = matches >= need[k + STEP]
        alive, matches = alive[going], matches[going]
    return alive


def connected(values: np.ndarray, band: int, side: np.ndarray | None, need: list[int]) -> Forest:
    """The rows of a bucket of `band` that are connected by pairs that survive.

    Each row meets one row of each component first, then only rows of components that it is not in: in a bucket of near
    copies about one comparison a row. A pair that shares an earlier band has met there and is passed over. side: block
    of each row where two blocks meet, so that only pairs across are compared."""
    keys, n = band_keys(values), len(values)
    forest, roots = Forest(n), np.arange(n)  # roots: of components so far, kept up as they grow

    def met(i: int, others: np.ndarray) -> None:
        alive = surviving(values, i, others, need)
        if band and len(alive):
            alive = alive[~(keys[alive, :band] == keys[i, :band]).any(1)]
        if len(alive):
            forest.join(i, alive)
            united = np.unique(np.append(roots[alive], roots[i]))
            roots[np.isin(roots, united)] = united[0]

    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[roots[others] != roots[i]] if side is None else others[(roots[others] != roots[i]) & (side[others] != side[i])]
        if len(others):
            _, first = np.unique(roots[others], return_index=True)
            if len(first) < len(others):
                met(i, others[first])
                others = others[roots[others] != roots[i]]
            met(i, others)
    return forest


def asked(values: np.ndarray, side: np.ndarray | None, need: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later rows whose pair with i shares a band and survives) of the rows of a cell's pair of blocks."""
    keys = band_keys(values)
    for i in range(len(values) - 1):
        alive = np.arange(i + 1, len(values)) if side is None else np.flatnonzero(side[i + 1 :] != side[i]) + i + 1
        alive = alive[(keys[alive] == keys[i]).any(1)]
        alive = surviving(values, i, alive, need)
        if len(alive):
            yield i, alive


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sets, exactly: products of the incidence of shingles that two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shingles, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    total = np.zeros((n, n), np.float32 if n < 1 << 11 else np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        total += x @ x.T  # sums of ones below 2^24 are exact
    return total


def overlaps(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, sizes of the intersections) of each row of pairs; by products if most pairs are asked for, else one by one."""
    if sum(len(js) for _, js in pairs) > len(sets) ** 2 // 8:
        both = intersections(sets)
        for i, js in pairs:
            yield i, js, both[i, js].astype(np.int64)
        return
    for i, js in pairs:
        mine, theirs = sets[i], np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        starts = np.concatenate(([0], np.cumsum([len(sets[j]) for j in js])))[:-1]
        yield i, js, np.add.reduceat((mine[at] == theirs).astype(np.int64), starts)


def links(sets: list[np.ndarray], copies: np.ndarray, pairs: list[tuple[int, np.ndarray]], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(linked documents, linked classes) of each set, and the forest of its links; the given pairs compared exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    documents, classes, forest = np.zeros(n, np.int64), np.zeros(n, np.int64), Forest(n)
    for i, js, both in overlaps(sets, pairs):
        # integers decide: |A n B| / |A u B| >= threshold
        js = js[both * (1 + threshold) >= threshold * (sizes[i] + sizes[js]) - 1e-9]
        documents[i] += copies[js].sum()
        classes[i] += len(js)
        documents[js] += copies[i]
        classes[js] += 1
        forest.join(i, js)
    return documents, classes, forest


def streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows by their first `keys` columns, from batches sorted by them; memory holds one group."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def sketched(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_key (md5), set_key (of its shingle set), n (shingles), values (MinHash)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("set_key", pa.binary()), ("n", pa.int64()), ("values", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            out: list[list] = [[], [], [], []]
            for text, s in zip(texts, shingle_sets(texts), strict=True):
                for column, value in zip(out, (hashlib.md5(text.encode()).digest(), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), minhash(s).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, text_key binary, set_key binary, n long, values binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each vertex's component, for edges (a, b); vertices of no other edge than (a, a) are left out.

    Every vertex points at its least neighbour, pointers are followed, and the graph is contracted to the roots; each
    round is written to the shared folder, and what it replaces is removed. A graph of n vertices takes about log n rounds."""
    spark = edges.sparkSession
    held: dict[str, str] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        out = write_table(df, path)
        if name in held:
            remove(spark, held[name])
        held[name] = path
        return out

    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    graph = keep(both, "edges")
    labels = graph.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct()
    while True:
        least = keep(graph.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "least")
        point = least
        for _ in range(2):
            ahead = point.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            point = point.join(ahead, "p").select("a", F.col("pp").alias("p"))
        point = keep(point, "point")
        left, right = point.select("a", F.col("p").alias("pa")), point.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        renamed = point.select(F.col("a").alias("root"), "p")
        labels = keep(labels.join(renamed, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        graph = keep(graph.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        if graph.isEmpty():
            for name in ("edges", "least", "point"):
                remove(spark, held[name])
            return labels


def n_blocks(members: Column, block: int, few: int) -> Column:
    """Blocks that a group of `members` is cut into."""
    return F.greatest(F.least(F.ceil(members / F.lit(block)), F.lit(few)), F.ceil(members / F.lit(MOST))).cast("int")


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), blocks).cast("int")


def in_blocks(df: DataFrame, key: str) -> DataFrame:
    """Deal each group's rows (with column blocks) to the pairs of its blocks: columns block, i, j with block in (i, j) and i <= j."""
    df = df.withColumn("block", block_of(F.col(key), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def candidates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): a class and the least that it is connected with in its bucket's pair of blocks, by pairs that survive.

    `sets`: cid, n, values. A bucket is a band and its bits; of buckets with the same members the one of the least band
    is enough, since a pair's first band cannot be later than it."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring("values", i * 2 * ROWS + 1, F.lit(2 * ROWS)).alias("bits")))
    dealt = sets.where("n > 0").select("cid", F.explode(bands).alias("key"))
    sums = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("size > 1")
    buckets = materialize(sums.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "buckets")
    met = dealt.join(buckets, "key").join(sets.select("cid", "values"), "cid")
    met = in_blocks(met.withColumn("blocks", n_blocks(F.col("size"), BLOCK, FEW)), "cid").select("key.band", "key.bits", "i", "j", "block", "cid", "values")
    need = least_matches(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for (band, _, i, j), group in streamed(batches, 4):
            values = np.frombuffer(b"".join(r[6] for r in group), VALUE).reshape(len(group), HASHES)
            ids = np.array([r[5] for r in group])
            roots = connected(values, band, None if i == j else np.array([r[4] for r in group]), need).roots()
            linked = np.flatnonzero(roots != np.arange(len(ids)))
            a += ids[linked].tolist()
            b += ids[roots[linked]].tolist()
            if len(a) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    order = ["band", "bits", "i", "j", "block", "cid"]
    return met.repartition("band", "bits", "i", "j").sortWithinPartitions(*order).mapInArrow(connect, "a long, b long")


def verified(docs: DataFrame, sets: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links, linked_sets) of the pairs in the cells that `found` (candidates) connects which reach the threshold:
    a class b, one connected with it, and the documents and classes of its links, in parts to be summed."""
    cells = components(found)
    # fetch the sets of cells' members once, by a document that has them
    about = sets.select(F.col("cid").alias("v"), "copies", "n", "values", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    sized = cells.join(about, "v")
    total = sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(n_blocks(F.col("members"), CELL_BLOCK, CELL_FEW), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)).cast("int"))
    sized = materialize(sized.join(total.select("root", blocks.alias("blocks")), "root"), "cells")
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").alias("rep_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("rep_key"), text.alias("text"))
    # members grow with the corpus: one plan for every size, not a broadcast while they are few
    fetched = source.join(sized.hint("merge"), source["rep_id"].eqNullSafe(sized["rep_id"]) & (source["rep_key"] == sized["rep_key"]))
    fetched = fetched.select("root", "v", "copies", "blocks", "text", "values")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets_ = [s.tobytes() for s in shingle_sets(b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(5), pa.array(sets_, pa.binary())], names=[*b.schema.names[:4], "values", "set"])

    columns = "root long, v long, copies long, blocks int, values binary, set binary"
    held = materialize(fetched.mapInArrow(to_sets, columns), "sets")
    large = held.where("blocks > 1")
    cores = large.where("v = root").dropDuplicates(["root"]).select("root", F.col("set").alias("core"))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            pairs = zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64), assume_unique=True).tobytes() for x, c in pairs], pa.binary())], names=b.schema.names[:6])

    apart = in_blocks(large.join(cores, "root").mapInArrow(differences, columns), "v").select("root", "i", "j", "block", "v", "copies", "values", "set")
    # a cell's core goes, as a row before the others, to each pair of its blocks once
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    core = large.where("v = root").dropDuplicates(["root"]).select("root", F.explode(every).alias("i"), "blocks", "set").select("root", "i", F.explode(F.filter(every, lambda j: j >= F.col("i"))).alias("j"), "set")
    core = core.select("root", "i", "j", F.lit(-1).alias("block"), F.lit(-1).cast("long").alias("v"), F.lit(0).cast("long").alias("copies"), F.lit(b"").alias("values"), "set")
    whole = held.where("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "v", "copies", "values", "set")
    together = whole.unionByName(apart).unionByName(core)
    schema, need = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("linked_sets", pa.int64())]), least_matches(threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (_, i, j), group in streamed(batches, 3):
            base = [np.frombuffer(r[7], np.uint64) for r in group if r[3] < 0]
            # repeated rows of one document bring its set again
            members = list({r[4]: r for r in group if r[3] >= 0}.values())
            values = np.frombuffer(b"".join(r[6] for r in members), VALUE).reshape(len(members), HASHES)
            pairs = list(asked(values, None if i == j else np.array([r[3] for r in members]), need))
            if not pairs:
                continue
            own = [np.frombuffer(r[7], np.uint64) for r in members]
            own = [np.setxor1d(x, base[0], assume_unique=True) for x in own] if base else own
            documents, linked, forest = links(own, np.array([r[5] for r in members]), pairs, threshold)
            roots = forest.roots()
            out += [{"a": members[int(roots[k])][4], "b": r[4], "links": int(documents[k]), "linked_sets": int(linked[k])} for k, r in enumerate(members) if linked[k]]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    placed = together.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "v")
    return placed.mapInArrow(verify, "a long, b long, links long, linked_sets long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents, classes) of `docs` (doc_id, text).

    documents: doc_id, text_key, set_key, one row a row of `docs`. classes: set_key, copies, rep_id and rep_key (the
    least document and its text's md5), links (documents of other sets at or above the threshold), linked_sets, and
    class_id, class_key: the least document of the connected class."""
    spark = docs.sparkSession
    keys, result = scratch(spark, "keys"), scratch(spark, "classes")
    with temporary(spark):
        sketch = materialize(sketched(docs), "sketch")
        sets = sketch.groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.any_value("n").alias("n"), F.any_value("values").alias("values"))
        sets = materialize(sets.withColumn("cid", F.monotonically_increasing_id()), "sets")
        documents = write_table(sketch.select("doc_id", "text_key", "set_key"), keys)
        found = materialize(candidates(sets, threshold), "candidates")
        linked = materialize(verified(docs, sets, found, threshold), "links")
        counted = linked.groupBy(F.col("b").alias("cid")).agg(F.sum("links").alias("links"), F.sum("linked_sets").alias("linked_sets"))
        joined = components(linked.select("a", "b")).withColumnRenamed("v", "cid")
        slim = sets.select("cid", "set_key", "copies", "rep").join(counted, "cid", "left").join(joined, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        head = slim.groupBy("root").agg(F.min("rep").alias("head"))
        out = slim.join(head, "root").select(
            "set_key", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("linked_sets", F.lit(0)).alias("linked_sets"), F.col("head.doc_id").alias("class_id"), F.col("head.text_key").alias("class_key"),
        )
        return documents, write_table(out, result)


@case_safe()
def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Similar documents of `docs` (doc_id, text): one row a row, with class_id, n_links, copy_id, n_copies.

    n_links counts the other documents whose shingle sets have a Jaccard similarity of `threshold` or more, copies
    included; class_id is the least doc_id of the documents connected by links; copy_id and n_copies are those of
    documents with an equal set. A null text is empty; texts without words are copies of each other and have no other
    links; a null doc_id counts as the least; repeated rows are copies; an empty table gives no rows; other columns
    are ignored."""
    documents, found = classes(docs, threshold)
    return documents.join(found, "set_key").select(
        "doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("rep_id").alias("copy_id"), F.col("copies").alias("n_copies"), "linked_sets"
    )


@case_safe(rows=True)
def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (doc_id, text, any others) that are the least document of their class, with their columns.

    Of repeated rows of one document one stays."""
    _, found = classes(docs, threshold)
    heads = found.select(F.col("class_id").alias("id"), F.col("class_key").alias("key")).distinct()
    keyed = boxed(docs).select("row", F.col("row.doc_id").alias("doc"), F.unhex(F.md5(F.encode(F.coalesce(F.col("row.text"), F.lit("")), "UTF-8"))).alias("text_key"))
    kept = keyed.join(heads, keyed["doc"].eqNullSafe(heads["id"]) & (keyed["text_key"] == heads["key"]), "left_semi")
    # rows that share both but differ elsewhere: the least hash of the whole row, so that reruns agree
    first = F.row_number().over(Window.partitionBy("doc", "text_key").orderBy(F.xxhash64("row")))
    return kept.withColumn("nth", first).where("nth = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {K} THEN list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingles FROM d
), sets AS (
    SELECT shingles, min(doc_id) AS rep, count(*) AS copies, len(shingles) AS n FROM s GROUP BY shingles
), each AS (
    SELECT rep, copies, n, unnest(shingles) AS x FROM sets
), pairs AS (
    SELECT a.rep AS a, b.rep AS b, b.copies AS copies FROM each a JOIN each b ON a.x = b.x AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, b.copies, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*))
), counts AS (
    SELECT a AS rep, sum(copies) AS links, count(*) AS linked_sets FROM pairs GROUP BY a
), reach AS (
    SELECT rep AS a, rep AS b FROM sets UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), heads AS (
    SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
)
SELECT doc_id, class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links, rep AS copy_id, copies AS n_copies, coalesce(linked_sets, 0)::BIGINT AS linked_sets
FROM s JOIN sets USING (shingles) JOIN heads USING (rep) LEFT JOIN counts USING (rep)
"""
