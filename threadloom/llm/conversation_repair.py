"""Conversation structure repair: window-derived faults, sorted turn structs, and a fold that carries four cheapest edits.

A repaired conversation's role initials are `(s?(ua)+)?`. After each turn the fold holds the cheapest way to stand at
the start, after a system turn, after a user's and after an assistant's: its cost and its audit, the initials of its
edits (K keep, R rerole, D delete, I insert). Of equally cheap ways the ASCII-least audit is kept, turn by turn: at one
state after one turn no audit is the beginning of another equally cheap one (it would hold an insert more, which
costs), so what follows both cannot turn their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import case_safe, table
from threadloom.llm.sharding import CRC_TABLE

#: Costs of edits, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Damage is drawn from a row's crc32 modulo MODULUS: what each of the first remainders does.
MODULUS, DROP, EMPTY, UNSTOP, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4
WORDLIKE, ENDED = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"
LEGAL = ("su", "ua", "au")
_WAY = "struct<cost:bigint,audit:string>"


def or_blank(x: Column) -> Column:
    """A value as text; null is one blank."""
    return F.coalesce(x.cast("string"), F.lit(" "))


@case_safe()
def damaged(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, gone after the damage that crc32(`conv_id:turn`) % 20 draws; null role and text are one blank.

    A dropped row stays as one that is gone, so that its conversation is still known. A repeated row comes twice (copy 0 and 1)."""
    draw = F.crc32(F.encode(F.concat(or_blank(F.col("conv_id")), F.lit(":"), or_blank(F.col("turn"))), "UTF-8")) % MODULUS
    text = F.when(F.col("draw") == EMPTY, "").when(F.col("draw") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == AS_USER, "user").otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", or_blank(F.col("role")).alias("role"), or_blank(F.col("text")).alias("text"), draw.alias("draw"))
    copies = F.when(F.col("draw") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == DROP).alias("gone"), F.explode(copies).alias("copy"))


def flagged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text, gone, copy) with their place, their first fault and whether they follow the turn before illegally.

    Places go by turn (nulls first), then role, text and copy. Rows are dealt by conversation once; both windows sort
    within that. Rows that are gone form a group of their own and count for nothing."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    own = Window.partitionBy("conv_id", "gone").orderBy(*order)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(WORDLIKE), "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    )
    pair = F.concat(F.lag("initial").over(own), F.col("initial"))
    return (
        rows.withColumn("initial", initial).withColumn("fault", fault)
        .withColumn("place", F.row_number().over(own)).withColumn("illegal", F.coalesce(~pair.isin(*LEGAL), F.lit(False)))
    )


def _step(way: Column, cost: Column | int, letter: str) -> Column:
    """A way with one more edit; null, where a state cannot be reached, stays null."""
    return F.when(way.isNotNull(), F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit")))


def _ways(start: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four ways with inserts before the next turn: a user turn after any but a user's, an assistant's after a user's."""
    user = F.least(user, _step(start, INSERT, "I"), _step(system, INSERT, "I"), _step(assistant, INSERT, "I"))
    return F.struct(start.alias("start"), system.alias("system"), user.alias("user"), F.least(assistant, _step(user, INSERT, "I")).alias("assistant"))


def _after(ways: Column, turn: Column) -> Column:
    """The four ways after one more turn (initial, spoilt: blank or duplicate, cost: of not deleting it)."""
    whole, initial, kept = ~turn["spoilt"], turn["initial"], turn["cost"]
    entry = F.least(ways["start"], ways["system"], ways["assistant"])  # where a user turn may follow
    keep = lambda way, letter: F.when(whole & (initial == letter), _step(way, kept, "K"))
    rerole = lambda way: F.when(whole, _step(way, kept + REROLE, "R"))
    gone = {name: _step(ways[name], DELETE, "D") for name in ("start", "system", "user", "assistant")}
    return _ways(
        gone["start"], F.least(gone["system"], keep(ways["start"], "s")), F.least(gone["user"], keep(entry, "u"), rerole(entry)),
        F.least(gone["assistant"], keep(ways["user"], "a"), rerole(ways["user"])),
    )


def cheapest(turns: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of turns (initial, spoilt, cost), in order."""
    none = F.lit(None).cast(_WAY)
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return F.aggregate(turns, _ways(zero, none, none, none), _after, lambda ways: F.least(ways["start"], ways["assistant"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit leaves, as `role:text` strings.

    Initials after an optional system turn alternate between user and assistant, so a turn's place says its role."""
    ops, out = F.translate(audit, "I", ""), F.translate(audit, "D", "")
    kept = F.filter(turns, lambda _, i: F.substring(ops, i + 1, F.lit(1)) != "D")

    def lines(held: Column) -> Column:
        shift = F.when((F.substring(out, 1, 1) == "K") & (F.substring(F.get(held, F.lit(0))["role"], 1, 1) == "s"), 1).otherwise(0)

        def line(at: Column) -> Column:
            letter = F.substring(out, at, F.lit(1))
            row = F.get(held, F.length(F.translate(F.substring(out, F.lit(1), at), "I", "")) - 1)
            turn = F.when((at - shift) % 2 == 1, "user").otherwise("assistant")
            return F.concat(F.when(letter == "K", row["role"]).otherwise(turn), F.lit(":"), F.when(letter == "I", "").otherwise(row["text"]))

        return F.when(F.length(out) > 0, F.transform(F.sequence(F.lit(1), F.length(out)), line)).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(kept), lines), 1)


def repair(rows: DataFrame) -> DataFrame:
    """Repair conversations (conv_id, turn, role, text, gone, copy): one row a conversation, with its repaired turns.

    Returns conv_id, gaps (turn numbers that are missing between the least and the greatest), blank, duplicate,
    truncated (turns by first fault), illegal (turns that may not follow the one before), cost, audit and repaired (an
    array of `role:text`). Null conv_ids are one conversation; null turns come first and count for no gap; turns of
    equal number go by role and text; roles are judged by their initial; a conversation whose rows are all gone has
    zeros, no audit and nothing repaired; an empty table gives no rows; other columns are ignored. A conversation's
    turns are folded in one task, as its repaired text is one value."""
    turn = F.struct("place", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("spoilt"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).cast("bigint").alias("cost"), "role", "text")
    here = ~F.col("gone")
    counted = lambda fault: F.count_if(here & (F.col("fault") == fault))
    there = F.when(here, F.col("turn"))
    convs = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0)).alias("gaps"), *[counted(x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.count_if(here & F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(F.when(here, turn))).alias("turns"),
    )
    convs = convs.withColumn("way", cheapest(F.col("turns")))
    return convs.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"), repaired(F.col("turns"), F.col("way.audit")).alias("repaired"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations")))
    return found.withColumn("repaired_sha256", F.sha2(F.encode(F.array_join("repaired", "\n"), "UTF-8"), 256)).drop("repaired")


_KEY = "encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
_BYTES = f"list_transform(regexp_extract_all(hex({_KEY}), '..'), lambda x: ('0x' || x)::BIGINT)"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, x: xor(c >> 8, {CRC_TABLE}[(xor(c, x) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"
#: Ways are texts, a cost of 9 digits and the audit after it, so that the least text is the least way; null: out of reach.
_SQL_STEP = "lpad((substr({0}, 1, 9)::BIGINT + {1})::VARCHAR, 9, '0') || substr({0}, 10) || '{2}'"


def _sql_inserted(z: str, s: str, u: str, a: str, source: str) -> str:
    step = lambda x: _SQL_STEP.format(x, INSERT, "I")
    user = f"least({u}, {step(z)}, {step(s)}, {step(a)})"
    return f"SELECT conv_id, i, z, s, u, least({a}, {step('u')}) AS a FROM (SELECT conv_id, i, {z} AS z, {s} AS s, {user} AS u, {a} AS a FROM {source})"


_GONE = lambda x: _SQL_STEP.format(f"w.{x}", DELETE, "D")
_KEEP = lambda x, c: f"CASE WHEN NOT spoilt AND initial = '{c}' THEN {_SQL_STEP.format(x, 'extra', 'K')} END"
_MOVE = lambda x: f"CASE WHEN NOT spoilt THEN {_SQL_STEP.format(x, f'extra + {REROLE}', 'R')} END"
_ENTRY = "least(w.z, w.s, w.a)"
SQL = f"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % {MODULUS} AS draw FROM conversations
), d AS (
    SELECT conv_id, turn, CASE WHEN draw = {AS_USER} THEN 'user' ELSE role END AS role, draw = {DROP} AS gone, copy,
           CASE WHEN draw = {EMPTY} THEN '' WHEN draw = {UNSTOP} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN draw = {REPEAT} THEN [0, 1] ELSE [0] END) AS copy FROM c)
), e AS (
    SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
           substr(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy), 1, 1) || substr(role, 1, 1) AS pair
    FROM d WHERE NOT gone
), f AS (
    SELECT *, fault IN ('blank', 'duplicate') AS spoilt, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra
    FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM e)
), n AS (
    SELECT o.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY o.conv_id
), w AS (
    {_sql_inserted("z", "s", "u", "a", "(SELECT conv_id, 0::BIGINT AS i, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM n)")}
    UNION ALL
    {_sql_inserted("z", "s", "u", "a", f'''(SELECT w.conv_id, w.i + 1 AS i, {_GONE("z")} AS z, least({_GONE("s")}, {_KEEP("w.z", "s")}) AS s,
      least({_GONE("u")}, {_KEEP(_ENTRY, "u")}, {_MOVE(_ENTRY)}) AS u, least({_GONE("a")}, {_KEEP("w.u", "a")}, {_MOVE("w.u")}) AS a
      FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)''')}
), b AS (
    SELECT n.*, least(z, a) AS way, substr(least(z, a), 10) AS audit FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
), k AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k, row, letter, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS place
    FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, substr(audit, pos, 1) AS letter, length(replace(substr(audit, 1, pos), 'I', '')) AS row FROM b)
), r AS (
    SELECT k.*, f.role, f.text, f.initial, max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.conv_id) AS shift
    FROM k LEFT JOIN f ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = k.row WHERE letter <> 'D'
), t AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS repaired FROM r GROUP BY conv_id
)
SELECT b.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, substr(way, 1, 9)::BIGINT AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM b LEFT JOIN t ON b.conv_id IS NOT DISTINCT FROM t.conv_id
"""
