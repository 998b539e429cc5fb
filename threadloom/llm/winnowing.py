"""Document fingerprints by winnowing polynomial hashes of k-grams.

The units are words; a run without blanks of more than LONGEST characters, as in scripts without spaces, counts as its
characters, so that every text has grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from threadloom.llm.common import case_safe, table, words_of

#: Units in a k-gram, and k-grams in a window: any run of K + WINDOW - 1 units that two texts share is found in both.
K, WINDOW = 5, 4
#: Longest run without blanks that is one unit.
LONGEST = 32
#: The rolling (Rabin-Karp) hash: a gram is the number in base BASE whose digits are its units' hashes, modulo the
#: greatest prime below 2^40. Products of a hash and BASE stay below 2^63, and so do those in halves of DROP, the weight
#: of the digit that leaves a gram.
PRIME, BASE = (1 << 40) - 87, 2654435
DROP = pow(BASE, K, PRIME)
#: Units that are folded at a time.
STRETCH = 64


def units(text: Column) -> Column:
    """The words of a text, in the place of each longer one than LONGEST its characters."""
    words = words_of(text)
    split = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONGEST, F.split(w, "")).otherwise(F.array(w))))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[^\\x20\\x09-\\x0D]{{{LONGEST + 1}}}"), split).otherwise(words)


def _rolled(digits: Column) -> Column:
    """The hash of a text's first 0, 1, 2 .. units, rolled on from unit to unit.

    Stretches are folded one after the other, each from where the last ended, so that what a fold appends to is short."""
    zero = F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), F.greatest(F.size(digits) - 1, F.lit(0)), F.lit(STRETCH))

    def on(done: Column, start: Column) -> Column:
        step = lambda run, d: F.array_append(run, (F.element_at(run, -1) * F.lit(BASE).cast("long") + d) % F.lit(PRIME))
        run = F.aggregate(F.slice(digits, start + 1, F.lit(STRETCH)), F.array(done["last"]), step)
        # a run begins with the last hash before it, which the run before has told
        told = F.element_at(F.transform(F.array(run), lambda r: F.struct(F.element_at(r, -1).alias("last"), F.array_append(done["runs"], F.slice(r, F.lit(2), F.lit(STRETCH))).alias("runs"))), 1)
        return told

    begin = F.struct(zero.alias("last"), F.array(F.array(zero)).alias("runs"))
    return F.aggregate(starts, begin, on, lambda done: F.flatten(done["runs"]))


def _dropped(h: Column) -> Column:
    """h * DROP modulo PRIME, in two halves of DROP."""
    half = 20
    high = (h * F.lit(DROP >> half).cast("long")) % F.lit(PRIME)
    return (F.shiftleft(high, half) % F.lit(PRIME) + (h * F.lit(DROP & ((1 << half) - 1)).cast("long")) % F.lit(PRIME)) % F.lit(PRIME)


def fingerprint(text: Column) -> Column:
    """Selected (h, back) structs of a text, hash and minus the position of a gram's first unit, in order of position.

    Each unit is hashed once, and the hashes of the text's beginnings are rolled on from unit to unit; a gram's is the
    difference of two, the earlier one moved up by K digits. Each window of WINDOW grams selects its least hash, the
    rightmost if several tie. A text of fewer than K units is one gram, one of fewer grams than a window is one window;
    a null text is empty and has no pairs. Positions have no bound."""

    def grams(p: Column) -> Column:
        n = F.size(p) - 1 - K
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.pmod(F.get(p, i + K) - _dropped(F.get(p, i)), F.lit(PRIME)).alias("h"), (-i).cast("long").alias("back")))

    def least(g: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(g) - WINDOW, F.lit(0)))
        chosen = F.transform(starts, lambda i: F.least(*[F.get(g, i + j) for j in range(WINDOW)]))
        # windows that choose one gram follow each other, so each is compared with the one before alone
        return bound(chosen, lambda c: F.filter(c, lambda x, i: (i == 0) | (x["back"] != F.get(c, i - 1)["back"])))

    none = F.array().cast("array<struct<h:bigint,back:bigint>>")
    hashed = F.transform(units(text), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))
    zeros = F.array(*[F.lit(0).cast("long")] * (K - 1))  # a short text's missing digits
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    padded = lambda u: F.when(F.size(u) >= K, u).otherwise(F.slice(F.concat(u, zeros), F.lit(1), F.lit(K)))
    return bound(hashed, lambda u: F.when(F.size(u) == 0, none).otherwise(bound(_rolled(padded(u)), lambda p: bound(grams(p), least))))


def hashes(pairs: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(pairs, lambda x: x["h"]))


def positions(pairs: Column) -> Column:
    """The k-gram positions (first unit, from 0) of a fingerprint's pairs."""
    return F.transform(pairs, lambda x: -x["back"])


def printed(pairs: Column) -> Column:
    """A fingerprint as text: 10 hexadecimal digits of hash, a colon and the position, pair by pair."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.lpad(F.hex(x["h"]), 10, "0"), F.lit(":"), (-x["back"]).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def with_next(docs: DataFrame, groups: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """`docs` (doc_id, text) with next_text, the text of the next document in descending doc_id; the last's is the first's.
    Also returns the window, for further columns of the next row; rows with `guest` are then to be dropped.

    Ranges of ids, cut at quantiles, are sorted each by itself. A range's first rows also go to the range before it,
    which sees them past its end, so one shuffle suffices and no task sorts everything. Null ids come last; rows of one
    id follow each other in order of text."""
    spark = docs.sparkSession
    groups = groups or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", "text", key.alias("k"))
    cuts = docs.agg(F.percentile_approx("k", [i / groups for i in range(groups + 1)], 100 * groups).alias("c"), F.max("k").alias("top")).first()
    tops = sorted({*(cuts["c"] or []), *([] if cuts["top"] is None else [cuts["top"]])})  # each is some row's key: the first of its range
    n, steps = len(tops), max(1, math.ceil(math.log2(len(tops) + 1)))
    ladder = F.array(*[F.lit(x) for x in tops]) if tops else F.array(F.lit(0).cast("long"))
    # how many cuts lie below k, by bisection over the sorted array
    below = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0),
        lambda lo, step: F.when((lo + step <= n) & (F.get(ladder, lo + step - 1) < F.col("k")), lo + step).otherwise(lo),
    )
    dealt = docs.withColumn("g", below).withColumn("heads", F.get(ladder, F.col("g")) == F.col("k"))
    here = F.struct(F.col("g").alias("g"), F.lit(False).alias("guest"))
    there = F.struct(F.when(F.col("g") + 1 < n, F.col("g") + 1).otherwise(0).alias("g"), F.lit(True).alias("guest"))
    seen = dealt.select("doc_id", "text", "k", F.explode(F.when(F.col("heads"), F.array(here, there)).otherwise(F.array(here))).alias("s"))
    order = Window.partitionBy("g").orderBy("guest", F.col("k").desc(), "text")
    seen = seen.select("doc_id", "text", "k", "s.g", "s.guest")
    return seen.withColumn("next_text", F.lead("text").over(order)), order


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen, order = with_next(docs)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))"))
    df = seen.withColumn("pairs", fingerprint(F.col("text"))).withColumn("own", hashes(F.col("pairs")))
    df = df.withColumn("next_own", F.lead("own").over(order)).where(~F.col("guest"))
    df = df.withColumn("edited", edited).withColumn("edited_pairs", fingerprint(F.col("edited")))
    return df.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        printed(F.col("pairs")).alias("fingerprint"), printed(F.col("edited_pairs")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_pairs"))).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
