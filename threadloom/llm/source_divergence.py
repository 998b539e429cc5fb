"""Source divergence audit: smoothed term shares of every source, their distances by sparse corrected pairs, and each
source's most divergent terms by radix selection.

1. Terms are counted by (language, source) within each batch of texts, then summed; a language keeps the terms that
   enough of its documents hold. Shares are integers, so all arithmetic is exact.
2. A source's share of a term that it lacks is its baseline. The distance of two sources is that of their baselines,
   once a kept term, corrected for what either holds: a source's own terms against the other's baseline, from the
   histogram of its shares, and the terms that both hold, by a join on the term.
3. The k-th greatest value of every source is found by counting values by their bits, DIGIT at a time from the highest;
   values equal to it are cut by their terms' bytes in the same way. Only terms that are reported are ever sorted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import case_safe, materialize, sliced, small, table

#: Documents of a language that must hold a term, what is added to each count, the scale of shares, and ranks of terms reported.
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bits of a digit of the radix selection, and digits of a value (below 2^30, as shares are); bytes of a digit of a term.
DIGIT, DIGITS, BYTES = 10, 3, 2
#: Distinct terms that a task holds before it passes its counts on, and characters of a text read at a time.
HELD, PIECE = 300_000, 1 << 22
#: Bytes as terms know them: A-Z in lower case, other ASCII characters but letters as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists: runs of letters A-Z and of what lies beyond ASCII, A-Z in lower case.

    Long texts are read in pieces; a run over a piece's end is carried into the next."""
    rest: list[bytes] = []
    for at in range(0, len(text), PIECE):
        folded = text[at : at + PIECE].encode("utf-8", "replace").translate(_FOLD)
        found = folded.split()
        if rest and found and folded[:1] != b" ":
            rest.append(found.pop(0))
            if not found and folded[-1:] != b" ":
                continue  # the run goes on
        if rest:
            yield [b"".join(rest)]
            rest = []
        if found and folded[-1:] != b" " and at + PIECE < len(text):
            rest = [found.pop()]
        yield found
    if rest:
        yield [b"".join(rest)]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a source and documents that hold it; a null term, once or more, for every source."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for key, terms in n.items():
                within = held[key]
                names = list(terms)
                size = len(names) + 1
                yield pa.record_batch(
                    [
                        pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.string()), pa.array([*names, None], pa.binary()).cast(pa.string()),
                        pa.array([*terms.values(), 0], pa.int64()), pa.array([*(within[t] for t in names), 0], pa.int64()),
                    ],
                    schema,
                )
            n.clear()
            held.clear()

        for b in sliced(batches):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                key = (lang, source)
                if key not in n:
                    n[key], held[key] = Counter(), Counter()
                total, seen = n[key], set()
                for found in terms_of(text):
                    total.update(found)
                    seen.update(found)
                held[key].update(seen)
                if len(seen) > HELD:
                    yield from passed()
            if sum(map(len, n.values())) > HELD:
                yield from passed()
        yield from passed()

    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return slim.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)), in decimals so that no product overflows; null without kept terms."""
    return F.when(F.col(kept) > 0, F.expr(f"1 + (CAST({n} + {ADDED} AS DECIMAL(20, 0)) * {SCALE}) div CAST({total} + {ADDED} * {kept} AS DECIMAL(20, 0))"))


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, held) of `docs` (text, lang, source), both written.

    groups: lang, source, kept (terms of the language), base (share of a term it lacks). held: lang, source, base, term,
    p, q for the kept terms that a source has, q being the language's share."""
    counts = materialize(counted(docs), "counts")
    named = counts.where("term IS NOT NULL")
    terms = materialize(named.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST).drop("docs"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    mine = materialize(named.drop("docs").join(terms, ["lang", "term"]), "mine")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "total_lang"]).withColumn("none", F.lit(0).cast("long")).withColumn("base", share("none", "total", "kept"))
    groups = materialize(groups.drop("none"), "groups")
    held = mine.join(small(groups), ["lang", "source"]).select("lang", "source", "base", "term", share("n", "total", "kept").alias("p"), share("n_lang", "total_lang", "kept").alias("q"))
    return groups.select("lang", "source", "kept", "base"), materialize(held, "held")


def distances(groups: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed distance of the shares of every two sources of a language.

    A join emits a row for each term that two sources share, which is summed as it comes; terms that one of them has
    count by the histogram of its shares. The result has a row a pair of sources, as asked for."""
    a, b = groups.select("lang", "kept", F.col("source").alias("a"), F.col("base").alias("base_a")), groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    pairs = a.join(b, "lang").where("a <> b")
    apart = F.abs(F.col("base_a") - F.col("base_b"))
    whole = pairs.select("lang", "a", "b", F.coalesce(F.col("kept") * apart, F.lit(0)).cast("long").alias("value"))
    # own terms against the other's baseline, both ways round
    bars = held.groupBy("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "p").agg(F.count(F.lit(1)).alias("n"))
    own = bars.join(b, "lang").where("a <> b").withColumn("more", F.col("n") * (F.abs(F.col("p") - F.col("base_b")) - apart))
    own = own.groupBy("lang", "a", "b").agg(F.sum("more").alias("value"))
    turned = own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    # terms of both: what the two corrections above got wrong
    left = held.select("lang", "term", F.col("source").alias("a"), F.col("base").alias("base_a"), F.col("p").alias("pa"))
    right = held.select("lang", "term", F.col("source").alias("b"), F.col("base").alias("base_b"), F.col("p").alias("pb"))
    mend = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("base_b")) - F.abs(F.col("base_a") - F.col("pb")) + apart
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(mend).alias("value"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    parts = whole.unionByName(own).unionByName(turned).unionByName(both)
    return parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def _crossed(counts: DataFrame, digit: Column, found: DataFrame, prefix: Column) -> DataFrame:
    """The digit, in order, at which a group's counts (n) reach `need`, or else its last: (keys, prefix, need, there).

    need: how many are still wanted from among those of that digit; there: how many there are."""
    keys = ["lang", "source"]
    run = Window.partitionBy(*keys).orderBy(digit)
    upto = counts.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("digit").over(run).isNull())
    upto = upto.join(small(found), keys).withColumn("before", F.col("upto") - F.col("n"))
    hit = upto.where((F.col("before") < F.col("need")) & ((F.col("upto") >= F.col("need")) | F.col("last")))
    return hit.select(*keys, prefix.alias("prefix"), (F.col("need") - F.col("before")).alias("need"), F.col("n").alias("there"))


def top_values(rows: DataFrame, most: int = TOP) -> DataFrame:
    """The `most` rows of each (lang, source) of `rows` (lang, source, term, value below 2^30) with the greatest values, ties by their terms' bytes.

    `rows` is read once a digit, so it should be written. A task sorts at most 1024 counts, 2^16 and some of them for
    bytes, whatever a group's size; only groups whose ties are cut read bytes."""
    keys = ["lang", "source"]
    found = materialize(rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(most).cast("long").alias("need")), "radix")
    for k in reversed(range(DIGITS)):
        shift = k * DIGIT
        mine = rows.join(small(found.select(*keys, "prefix")), keys).where(F.shiftright("value", shift + DIGIT) == F.col("prefix"))
        counts = mine.groupBy(*keys, F.shiftright("value", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        found = materialize(_crossed(counts, F.col("digit").desc(), found.select(*keys, "need"), F.col("digit")), "radix")
    bars = materialize(found.select(*keys, F.col("prefix").alias("bar"), "need", "there", F.lit("").alias("prefix")), "bars")
    # an end mark below all digits: no term's spelling begins another's, and order is still that of bytes
    spelt = F.concat(F.hex(F.encode("term", "UTF-8")), F.lit("!"))
    ties = rows.join(small(bars.where("there > need").select(*keys, "bar")), keys).where("value = bar").select(*keys, spelt.alias("spelt"))
    done, at = bars.where("there <= need").select(*keys, "bar", "prefix"), 0
    open_ = bars.where("there > need")
    while not open_.isEmpty():
        if at == 0:
            ties = materialize(ties, "ties")
        width = 2 * BYTES * (at + 1)
        mine = ties.join(small(open_.select(*keys, "prefix")), keys).where(F.substring("spelt", 1, 2 * BYTES * at) == F.col("prefix"))
        counts = mine.groupBy(*keys, F.substring("spelt", 1, width).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        cut = _crossed(counts, F.col("digit"), open_.select(*keys, "need"), F.col("digit"))
        cut = materialize(cut.join(small(open_.select(*keys, "bar")), keys), "bars")
        done, at = done.unionByName(cut.where("there <= need").select(*keys, "bar", "prefix")), at + 1
        open_ = cut.where("there > need")
    first = F.expr("substring(spelt, 1, length(prefix))")
    chosen = rows.withColumn("spelt", spelt).join(small(materialize(done, "cuts")), keys)
    return chosen.where((F.col("value") > F.col("bar")) | ((F.col("value") == F.col("bar")) & (first <= F.col("prefix")))).select(*rows.columns)


@case_safe()
def audit(docs: DataFrame) -> DataFrame:
    """Audit the sources of `docs` (text, lang, source): lang, source, part, item, value, rank.

    Part `pair`: every other source of the language with the summed distance of shares; part `term`: the TOP terms whose
    share most exceeds the language's. Ranks go by value, then by the item's UTF-8 bytes. Null text, lang and source
    are ''; texts without terms, and languages that keep none, have distances of 0 and no terms; repeated rows count
    as documents of their own; an empty table gives no rows; other columns are ignored."""
    groups, held = shares(docs)
    above = materialize(held.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")), "above")
    terms = top_values(above).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = distances(groups, held).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SHARE = f"(1 + ((({{0}})::HUGEINT + {ADDED}) * {SCALE}) // ({{1}} + {ADDED} * v))::BIGINT"
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') AS w FROM documents
), g AS (
    SELECT DISTINCT lang, source FROM d
), e AS (
    SELECT id, lang, source, unnest(w) AS term FROM d
), t AS (
    SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}
), l AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang
), c AS (
    SELECT e.lang, source, e.term, count(*) AS n FROM e JOIN t ON e.lang = t.lang AND e.term = t.term GROUP BY e.lang, source, e.term
), s AS (
    SELECT g.lang, g.source, v, l.total AS total_lang, coalesce(sum(n), 0) AS total FROM g JOIN l ON g.lang = l.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source, v, l.total
), p AS (
    SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "s.total")} AS p, {_SHARE.format("t.n", "total_lang")} AS q
    FROM s JOIN t ON s.lang = t.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
), f AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f
) WHERE part = 'pair' OR rank <= {TOP}
"""
