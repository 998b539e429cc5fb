"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import boxed, case_safe, grouped_index, materialize, n_words_of, table

#: Weights of the sources in code-point order, repeating; the mix takes SHARE of all sizes, a source at most MOST times its own.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Tokens of a block.
BLOCK = 512
#: The golden-ratio sequence in integers: point t is t * STEP mod 2^BITS, STEP being odd and next to 2^BITS / phi. The
#: product is taken in two halves of STEP, so that none of them passes 2^63 for t below 2^BITS.
BITS = 40
STEP = 679_535_556_991
#: Cells of the points' range (source look-up), and slots ranked in one task. A source's shuffled documents are numbered
#: in 4096 buckets, by the first three digits of their place. Sources beyond MOST_SOURCES are refused: their weights and
#: caps are ranked in one task.
CELLS, CHUNK, MOST_SOURCES = 1024, 8192, 1_000_000


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets by water filling: shares by weight, stopped at `most` times a source's size, the excess reshared.

    `sources` has one row a source (source, source_size), so its windows hold one row a source only. Sorted by
    cap / weight, source k is full if its cap is at most weight times the level that the rest still need."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("k", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("line", F.min(F.when(~F.col("full"), F.struct("k", "level"))).over(everything)["level"])
    )
    return level.select(
        "source", "source_size", F.when(F.col("full") | F.col("line").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("line")).alias("target")
    )


def stream_order(doc_id: Column) -> Column:
    """The place of a document in its source's shuffled stream, as text: the md5 of its id."""
    return F.md5(F.encode(F.concat(F.lit("mix|"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"))


def point(t: Column) -> Column:
    """The t-th point of the golden-ratio sequence, from [0, 1)."""
    half, modulus = BITS // 2, 1 << BITS
    high = F.shiftleft(F.pmod(t * F.lit(STEP >> half).cast("long"), F.lit(1 << half).cast("long")), half)
    low = t * F.lit(STEP & ((1 << half) - 1)).cast("long")
    return F.pmod(high + F.pmod(low, F.lit(modulus)), F.lit(modulus)) / F.lit(float(modulus))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The mix, slot by slot: (slot, sid, rank, block, tokens); slots are in order, with gaps.

    A source has as many slots as its own target takes, short blocks and small sources included. Slot t belongs to the
    source whose interval of the cumulative weights, the sources' shares of all slots, holds the t-th point of the
    golden-ratio sequence, so every stretch of the mix holds each source by its share to within a few slots. Slots are
    ranked within their source; the rank-th takes the source's block rank mod blocks, and the last is cut so that its
    tokens end at the source's target. Points that fall to a source beyond its last slot are passed over, and what few
    slots a source lacks at the end come after all others. `targets` has sid, source_size, target."""
    spark = targets.sparkSession
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / F.lit(block))
    order = Window.orderBy("sid")
    # a round over a source's blocks yields source_size tokens, its last block being short
    parts = (
        targets.withColumn("words", F.round("target").cast("long")).where((F.col("words") > 0) & (size > 0))
        .withColumn("rounds", F.floor(F.col("words") / size))
        .withColumn("n", (F.col("rounds") * blocks + F.ceil((F.col("words") - F.col("rounds") * size) / F.lit(block))).cast("long"))
        .withColumn("hi", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("lo", F.col("hi") - F.col("n"))
    )
    parts = materialize(parts.select("sid", size, "words", "n", "lo", "hi"), "parts")
    total, few = parts.agg(F.max("hi"), F.count(F.lit(1))).first()  # two numbers
    if few > MOST_SOURCES or (total or 0) >= 1 << BITS:
        raise ValueError(f"at most {MOST_SOURCES} sources and 2^{BITS} slots can be scheduled")
    total = total or 0
    share = lambda at: at / F.lit(float(max(total, 1)))
    cell = lambda at: F.least(F.floor(at * CELLS), F.lit(CELLS - 1))
    spans = parts.withColumn("cell", F.explode(F.sequence(cell(share(F.col("lo"))), cell(share(F.col("hi"))))))
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("at", point(F.col("slot"))).withColumn("cell", cell(F.col("at")))
    held = points.join(spans, "cell").where((F.col("at") >= share(F.col("lo"))) & (F.col("at") < share(F.col("hi"))))
    held = held.select("sid", "words", "source_size", "n", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ranked = grouped_index(materialize(held, "slots"), ["sid"], "chunk", ["slot"], "rank").where("rank < n")
    have = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("have"))
    lacking = parts.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < n")
    # the sequence's discrepancy bounds these: some slots a source, however many there are in all
    lacking = lacking.select("sid", "words", "source_size", F.explode(F.sequence(F.col("have"), F.col("n") - 1)).alias("rank"))
    lacking = lacking.withColumn("slot", F.lit(total) + F.row_number().over(Window.orderBy("rank", "sid")) - 1)
    columns = ["slot", "sid", "rank", "words", "source_size"]
    whole = ranked.select(*columns).unionByName(lacking.select(*columns)).withColumn("block", F.pmod("rank", blocks)).withColumn("blocks", blocks)
    start = F.floor(F.col("rank") / F.col("blocks")) * size + F.col("block") * block
    tokens = F.least(F.lit(block), size - F.col("block") * block)
    return whole.select("slot", "sid", "rank", "block", F.least(tokens, F.col("words") - start).cast("long").alias("tokens"))


@case_safe()
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix `docs` (doc_id, text, source) to target weights: (documents, schedule, sources).

    documents: doc_id, size (words), source_size, target, taken, source, sid, start. A source's documents are shuffled
    by a hash, laid end to end and cut into blocks of equal length; slots of the schedule join blocks by rank, and a
    document is taken as often as the slots cover its words. Null sources are one source, last in order; null and
    empty texts have size 0 and are never taken; repeated rows are laid out one after the other; an empty table gives
    no rows; other columns are ignored."""
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    slim = docs.select(
        "doc_id", "source", source.alias("sid"), n_words_of(F.col("text")).alias("size"),
        stream_order(F.col("doc_id")).alias("h"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"),
    ).withColumn("b", F.substring("h", 1, 3))
    slim = materialize(slim, "mix")
    sources = with_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = materialize(sources.withColumn("sid", source), "sources")
    # each document's place in its source's stream: sums by bucket, then within a bucket
    bucket = slim.groupBy("sid", "b").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("sid", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "b").orderBy("h", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = slim.join(bucket, ["sid", "b"]).withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))
    laid = laid.withColumn("id", F.monotonically_increasing_id()).select("id", "doc_id", "source", "sid", "size", "crc", "start")
    laid = materialize(laid, "laid")
    slots = materialize(schedule(sources.select("sid", "source_size", "target"), block), "schedule")
    used = slots.groupBy("sid", "block", "tokens").count()
    end = F.col("start") + F.col("size")
    pieces = laid.where("size > 0").select(
        "id", "sid", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block")
    )
    first = F.col("block") * block
    covered = F.greatest(F.lit(0), F.least("end", first + F.col("tokens")) - F.greatest("start", first))
    taken = pieces.join(used, ["sid", "block"]).groupBy("id").agg(F.sum(covered * F.col("count")).alias("taken"))
    mixed = (
        laid.join(taken, "id", "left")
        .join(sources.select("sid", "source_size", "target"), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "sid", "crc", "start")
    )
    return mixed, slots, sources


@case_safe(rows=True)
def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, any others) as the mix takes them, with their columns, whatever their names.

    A source's stream is taken from its start, round after round, so that a row is taken whole or not at all but for
    the one at each stream's end, which is rounded. A row taken twice comes twice; one not taken is left out."""
    rows = mix(docs, weights, share, most)[0]
    key = ["id", "sid", "crc", "k"]
    nth = lambda order: F.row_number().over(Window.partitionBy("id", "sid", "crc").orderBy(order))  # noqa: E731  rows that share these are told apart by all their columns
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = rows.select(text(F.col("doc_id")).alias("id"), "sid", "crc", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("times")).withColumn("k", nth(F.col("times").desc()))
    source = F.when(F.col("row.source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("row.source")))
    keyed = boxed(docs).select("row", text(F.col("row.doc_id")).alias("id"), source.alias("sid"), F.crc32(F.encode(text(F.col("row.text")), "UTF-8")).alias("crc")).withColumn("k", nth(F.xxhash64("row")))
    taken = keyed.join(rows.where("times > 0"), key).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return taken.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


#: A source's stream is taken round after round, so what a document gives follows from its place in the stream.
SQL = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, {list(map(float, WEIGHTS))}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight, source_size * {float(MOST)}::DOUBLE AS cap FROM s
), l AS (
    SELECT *, row_number() OVER r AS k, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST), before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, CASE WHEN cap <= weight * level OR line IS NULL THEN cap ELSE weight * line END AS target
    FROM (SELECT *, (SELECT arg_min(level, k) FROM l WHERE NOT cap <= weight * level) AS line FROM l)
), p AS (
    SELECT doc_id, size, source_size, target, round(target)::BIGINT AS words, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(start + size, words % source_size) - start) END::BIGINT AS taken
FROM p
"""
