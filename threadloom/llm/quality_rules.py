"""Quality rules by distribution divergence: Jensen-Shannon distance of a document's histograms to language references.

Both references of a language are learned from the table: the mean histogram of character classes, and the mean
histogram over the language's own most frequent words. No word list is written down here."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import SPACE_CLASS, boxed, case_safe, materialize, table

#: Most frequent words of a language that make up its histogram.
WORDS = 25
#: A language has references if it has at least this many documents of LEAST_WORDS words, and this share (one in
#: LEAST_SHARE) of all documents with a language: at most LEAST_SHARE references are ever collected.
LEAST_DOCUMENTS, LEAST_SHARE = 20, 1000
#: Base rule: fewer words, or a larger share (per cent) of words in repeated 3-word windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is rejected if a distance exceeds floor + slope / sqrt(words): a short text's histogram is farther by chance.
CLASS_LIMIT, WORD_LIMIT = (0.13, 1.0), (0.14, 2.0)
#: Means are sums of whole billionths, so that they do not depend on order.
UNIT = 1_000_000_000
#: Distinct repeated windows of a text up to which each window is searched for among them.
FEW_REPEATS = 32
LETTERS, NOT_LETTERS = "[\\p{L}\\p{M}]+", "[^\\p{L}\\p{M}]+"


def _left(text: Column, pattern: str) -> Column:
    """Characters of a text that remain without what the pattern matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at the given places, in order."""
    return F.aggregate(F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)


def with_repeats(df: DataFrame) -> DataFrame:
    """`df` (windows: hashes of a text's 3-word windows in order, ...) with n_repeat: words in windows found twice or more.

    A text without repeats is seen by its distinct windows. One with few repeated windows is searched for them, one
    with many is sorted with its places."""
    n = F.size("windows")
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < n, F.sort_array("windows")))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: F.coalesce(F.get("sorted", i + 1) == x, F.lit(False)))))
    found = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())

    def neighbours(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.when(F.size("twice") <= FEW_REPEATS, found).when(F.size("twice") > FEW_REPEATS, _bound(placed, neighbours))
    return df.withColumn("places", places).withColumn("n_repeat", F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long")).drop("windows", "sorted", "twice", "places")


def letter_words(text: Column) -> Column:
    """The runs of letters in a text, in lower case, as 64-bit hashes: they are only ever compared."""
    return F.transform(F.array_remove(F.split(F.lower(text), NOT_LETTERS), ""), lambda x: F.xxhash64(x))


def frequent_words(docs: DataFrame) -> dict[str, list[int]]:
    """The WORDS most frequent words of each language with enough documents, over all its documents of LEAST_WORDS runs of letters.

    A word counts by its share of each document, its first occurrence left out: long documents weigh no more than
    short ones, and words that no document repeats, which are most of a vocabulary, are not counted at all. Ties go by
    hash. Counts are combined before the shuffle and each task ranks before the next, so what reaches the driver is
    at most WORDS words of LEAST_SHARE languages."""
    known = docs.where(F.col("lang").isNotNull())
    least = max(LEAST_DOCUMENTS, -(-known.count() // LEAST_SHARE))
    langs = [r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("lang").collect()]
    if not langs:
        return {}

    def repeated(w: Column) -> Column:
        again = _bound(F.sort_array(w), lambda x: F.filter(x, lambda y, i: F.coalesce(F.get(x, i + 1) == y, F.lit(False))))
        return F.when(F.size(w) >= LEAST_WORDS, F.struct(F.floor(F.lit(UNIT) / F.size(w)).cast("long").alias("n"), again.alias("again")))

    # bound values: a filter on a column of words would have them split again, and a lambda over it for each word
    words = known.where(F.col("lang").isin(langs)).select("lang", _bound(letter_words(F.col("text")), repeated).alias("r"))
    counted = words.select("lang", "r.n", F.explode("r.again").alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    found: dict[str, list[int]] = {}
    for row in counted.withColumn("k", rank).where(F.col("k") <= WORDS).select("lang", "word").collect():
        found.setdefault(row["lang"], []).append(row["word"])
    return {lang: sorted(words) for lang, words in sorted(found.items())}


def counted(docs: DataFrame, words: dict[str, list[int]]) -> DataFrame:
    """`docs` as (row, q): their columns, boxed, and a struct of counts.

    q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; kinds (characters in lower case and other letters,
    upper case, digits, white space, marks, others) of chars; uncased (more than half of the characters outside white
    space are letters of scripts without case); found and times (the languages' frequent words that the text has, and
    how often) of letter_words; text_hash."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = boxed(docs).select("row", text.alias("t")).select("*", F.array_remove(F.split("t", SPACE_CLASS), "").alias("w"), letter_words(F.col("t")).alias("l"), F.regexp_replace("t", LETTERS, "").alias("bare"))
    # each replacement works on what the one before has left: few characters are neither letters nor spaces
    df = df.withColumn("rest", F.regexp_replace("bare", SPACE_CLASS, ""))
    t, w, rest = (F.col(c) for c in ("t", "w", "rest"))
    spaces = (F.length("bare") - F.length(rest)).cast("long")
    bins = sorted({x for ws in words.values() for x in ws})
    hits = F.sort_array(F.filter("l", lambda x: x.isin(bins))) if bins else F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # such letters take two bytes or more
    solid = F.length(t) - spaces
    uncased = F.when(2 * (F.octet_length(t) - spaces) > 3 * solid, 2 * _left(t, "[^\\p{Lo}]+") > solid).otherwise(False)
    counts = {
        "n_words": F.size(w).cast("long"), "chars": F.length(t).cast("long"), "spaces": spaces, "upper": _left(t, "[^\\p{Lu}]+"),
        "others": F.length(rest).cast("long"), "digits": _left(rest, "[^\\p{N}]+"), "marks": _left(rest, "[^.,;:'\"?!()-]+"), "n_symbols": _left(rest, "[^#*$%&|<>]+"),
        "uncased": uncased, "letter_words": F.size("l").cast("long"), "text_hash": F.xxhash64(t),
        "n_dup_lines": F.when(F.instr(t, "\n") > 0, _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long"),
    }
    # texts and words are dropped here: a plan's further steps would copy them along
    df = df.select("row", F.struct(*[c.alias(k) for k, c in counts.items()]).alias("c"), hits.alias("hits"), F.when(F.size(w) >= 3, windows).alias("windows"))
    # a run of equal words ends where the next differs
    ends = F.filter(F.transform("hits", lambda x, i: F.when(~F.coalesce(F.get("hits", i + 1) == x, F.lit(False)), i + 1)), lambda x: x.isNotNull())
    df = with_repeats(df.withColumn("ends", ends))
    c = F.col("c")
    kinds = [c["chars"] - c["spaces"] - c["others"] - c["upper"], c["upper"], c["digits"], c["spaces"], c["marks"], c["others"] - c["digits"] - c["marks"]]
    q = {
        "word_chars": c["chars"] - c["spaces"], **{k: c[k] for k in ("n_words", "n_symbols", "n_dup_lines", "chars", "uncased", "letter_words", "text_hash")}, "n_repeat_words": F.col("n_repeat"), "kinds": F.array(*kinds),
        "found": F.transform("ends", lambda e: F.get("hits", e - 1)), "times": F.transform("ends", lambda e, i: (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("long")),
    }
    return df.select("row", F.struct(*[x.alias(k) for k, x in q.items()]).alias("q"))


def histogram(words: Column) -> Column:
    """Occurrences of each of `words` in a text of counts q, and of all its other words, in one array."""
    at = F.map_from_arrays(F.col("q.found"), F.col("q.times"))
    n = _bound(at, lambda m: F.transform(words, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(0).cast("long"))))
    return _bound(n, lambda x: F.concat(x, F.array(F.col("q.letter_words") - F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))))


def references(counts: DataFrame, words: dict[str, list[int]]) -> dict[str, dict]:
    """{lang: kinds, words, shares}: mean histograms over the distinct texts of LEAST_WORDS words of each language of `words`.

    Copies count once, so that a text that fills a third of the table is no reference by itself. What reaches the
    driver is one number a language and bin."""
    if not words:
        return {}
    own = F.try_element_at(F.from_json(F.lit(json.dumps(words)), "map<string,array<bigint>>"), F.col("row.lang"))
    known = counts.where(F.col("row.lang").isin(list(words)) & (F.col("q.n_words") >= LEAST_WORDS) & (F.col("q.letter_words") > 0))
    shares = lambda bins, n: F.transform(bins, lambda x: F.floor(x * F.lit(UNIT) / n).cast("long"))
    each = known.select(F.col("row.lang").alias("lang"), F.col("q.text_hash").alias("h"), F.concat(shares(F.col("q.kinds"), F.col("q.chars")), shares(histogram(own), F.col("q.letter_words"))).alias("x"))
    bins = each.groupBy("lang", "h").agg(F.any_value("x").alias("x")).select("lang", F.posexplode("x"))
    rows = bins.groupBy("lang", "pos").agg(F.sum("col").alias("total"), F.count(F.lit(1)).alias("n")).collect()
    means: dict[str, dict[int, float]] = {}
    for r in rows:
        if r["n"] >= LEAST_DOCUMENTS:
            means.setdefault(r["lang"], {})[r["pos"]] = r["total"] / r["n"] / UNIT
    return {lang: {"kinds": [m[i] for i in range(6)], "words": words[lang], "shares": [m[i] for i in range(6, 7 + len(words[lang]))]} for lang, m in sorted(means.items())}


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def judged(counts: DataFrame, refs: dict[str, dict]) -> DataFrame:
    """(row, q, base_failed, class_distance, word_distance, kept) of `counts`.

    A distance is that to the reference of the document's language, or if that exceeds the limit to the nearest of all
    references, so that a wrong language does no harm. Where no reference applies, a distance is null and its rule
    abstains: the word rule for a document whose language is null or has no reference, the class rule if such a
    document's letters have no case, and both where no language has a reference. Distances of texts that fail the base
    rule are null."""
    n = F.col("q.n_words")
    df = counts.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * n))
    limit = lambda x: x[0] + x[1] / F.sqrt(n.cast("double"))
    share = lambda bins, total: F.transform(bins, lambda x: x / F.greatest(total, F.lit(1)).cast("double"))
    nothing = F.lit(None).cast("double")
    if refs:
        held = F.from_json(F.lit(json.dumps(refs)), "map<string,struct<kinds:array<double>,words:array<bigint>,shares:array<double>>>")
        own = F.try_element_at(held, F.col("row.lang"))
        kinds = share(F.col("q.kinds"), F.col("q.chars"))
        by_class = lambda r: distance(kinds, r["kinds"])
        by_words = lambda r: distance(share(histogram(r["words"]), F.col("q.letter_words")), r["shares"])
        nearest = lambda by: F.array_min(F.transform(F.map_values(held), by))
        first = lambda by, bound: _bound(by(own), lambda d: F.when(d <= bound, d).otherwise(nearest(by)))
        classes = F.when(own.isNotNull(), first(by_class, limit(CLASS_LIMIT))).when(~F.col("q.uncased"), nearest(by_class))
        words = F.when(own.isNotNull() & (F.col("q.letter_words") > 0), first(by_words, limit(WORD_LIMIT)))
    else:
        classes = words = nothing
    df = df.withColumn("class_distance", F.when(~F.col("base_failed"), classes)).withColumn("word_distance", F.when(~F.col("base_failed"), words))
    far = F.coalesce(F.col("class_distance") > limit(CLASS_LIMIT), F.lit(False)) | F.coalesce(F.col("word_distance") > limit(WORD_LIMIT), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


@case_safe()
def rated(docs: DataFrame) -> DataFrame:
    """judged() over `docs` (text, lang, any others), which are read twice: for the languages' words, and for all counts."""
    words = frequent_words(docs)
    counts = materialize(counted(docs, words), "quality")  # costly: computed once, for the references and the verdicts
    return judged(counts, references(counts, words))


@case_safe(rows=True)
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (text, lang, any others) that the rules keep, with their columns, whatever their names.

    Null and empty texts have no words and fail the base rule. Null languages add nothing to a reference and are
    judged by character classes alone; without any reference only the base rule judges. Each row is judged by itself:
    repeated rows fare alike; an empty table gives no rows."""
    return rated(docs).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # the text is not needed again
    words = frequent_words(docs)
    slim = counted(docs, words).withColumn("row", F.col("row").dropFields("text"))
    counts = materialize(slim, "quality")
    return judged(counts, references(counts, words)).select(
        "row.doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
