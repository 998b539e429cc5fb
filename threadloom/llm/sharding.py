"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import case_safe, grouped_index, materialize, table

N_SHARDS = 40
#: Draws are numbers below a prime; a shard's own constants come from these multipliers.
PRIME, FIRST, SECOND = (1 << 31) - 1, 1140671485, 69069
#: Bits of a key's md5 that a draw starts from: two numbers of 30.
HALF = 1 << 30


def key_digest(key: Column) -> Column:
    """The md5 of a record's key, as text; a null key is the empty string."""
    return F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))


def rendezvous(digest: Column, weights: list[float]) -> Column:
    """Shard of a key by its digest: each shard draws -ln(u)/weight with u mixed from (shard, key); the least draw wins.

    A shard's draws do not depend on the other shards, so a further shard only takes keys into itself and a removed
    one only gives its own away; a shard's share is its weight's. Equal draws go to the first shard."""
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    p = F.lit(PRIME).cast("long")

    def placed(n: Column) -> Column:
        def draw(weight: Column, i: Column) -> Column:
            x = (F.shiftright(n, 30) + i.cast("long") * F.lit(FIRST)) % p
            y = (x * x + n % F.lit(HALF)) % p
            z = (y * y + i.cast("long") * F.lit(SECOND)) % p
            return F.struct((-F.ln((z.cast("double") + 0.5) / F.lit(float(PRIME))) / weight).alias("draw"), i.alias("shard"))

        return F.array_min(F.transform(F.array(*[F.lit(float(w)) for w in weights]), draw))["shard"].cast("int")

    return F.element_at(F.transform(F.array(number), placed), 1)


@case_safe()
def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id") -> DataFrame:
    """Place every row of `docs` (doc_id, text) in a shard of `weights`; `grown`: also its shard under other weights.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null text: of no bytes), law,
    shard, slot (gapless from 0 in each shard, by the key's md5), grown_shard. Null keys all share one key; repeated
    rows share a shard and get slots of their own; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key_digest(F.col(key)).alias("h"),
    )
    slim = slim.withColumn("shard", rendezvous(F.col("h"), weights)).withColumn("grown_shard", rendezvous(F.col("h"), grown) if grown else F.lit(None).cast("int"))
    slim = slim.withColumn("b", F.substring("h", 1, 2))
    placed = grouped_index(materialize(slim, "shard"), ["shard"], "b", ["h", "size", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))


def _crc_table() -> list[int]:
    """The table of crc32's polynomial, a row a byte."""
    rows = list(range(256))
    for _ in range(8):
        rows = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in rows]
    return rows


#: For SQL twins.
CRC_TABLE = _crc_table()


def _placed(shards: int) -> str:
    draws = f"list_transform(range({shards}), lambda i: (n // {HALF} + i * {FIRST}) % {PRIME})"
    draws = f"list_transform({draws}, lambda x: (x * x + n % {HALF}) % {PRIME})"
    draws = f"list_transform({draws}, lambda y, i: (y * y + (i - 1) * {SECOND}) % {PRIME})"
    return f"list_position({draws}, list_max({draws})) - 1"


#: With equal weights the least -ln(u) is the greatest u. crc32 goes byte by byte through its table.
SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(doc_id::VARCHAR, '')) AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS n FROM documents
), p AS (
    SELECT *, strlen(t) + 16 AS size, {_placed(N_SHARDS)} AS shard, {_placed(N_SHARDS + 1)} AS grown,
           xor(list_reduce(list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, {CRC_TABLE}[(xor(c, x) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
    FROM d
)
SELECT doc_id, size::BIGINT AS size, CASE WHEN t = '' THEN 0 ELSE crc END::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h, size) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM p
"""
