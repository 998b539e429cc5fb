"""Study submissions as Column functions: validation, orders, ranks and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import distinct_ranks, enough_words

#: Fewest words of each written answer, and the bounds of scores.
LEAST_WORDS = {"user_response": 25, "profile": 40, "comparison": 10, "feedback": 10, "reason": 15, "interests": 50}
SCORES = (1, 10)
LAST_RANK = "9"


def problems(answers: dict[str, Column], scores: list[Column], ranks: list[Column]) -> Column:
    """The names of what is wrong with a submission; empty if it is valid."""
    checks = [F.when(~enough_words(a, LEAST_WORDS[k]), F.lit(k)) for k, a in answers.items()]
    checks += [F.when(~F.coalesce(s.between(*SCORES), F.lit(False)), F.lit(f"score_{i}")) for i, s in enumerate(scores)]
    if ranks:
        checks.append(F.when(~F.coalesce(distinct_ranks(*ranks), F.lit(False)), F.lit("ranks")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def by_rank(ranks: Column) -> Column:
    """The keys of a map in order of rank, keys without one last, equal ranks by key."""
    entries = F.transform(F.map_entries(ranks), lambda e: F.struct(F.coalesce(e["value"], F.lit(LAST_RANK)).alias("rank"), e["key"].alias("key")))
    return F.transform(F.array_sort(entries), lambda e: e["key"])


def shown_order(options: list[str], key: Column, seed: int) -> Column:
    """Options in an order that depends on a key alone."""
    named = F.array(*[F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(o))).alias("h"), F.lit(o).alias("o")) for o in options])
    return F.transform(F.array_sort(named), lambda x: x["o"])


def in_order(values: Column, order: Column) -> Column:
    """A map's values in a given order of its keys."""
    return F.transform(order, lambda k: F.element_at(values, k))


def elapsed(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def fallback_persona(age: Column, gender: Column, occupation: Column) -> Column:
    """One sentence from what a profile has."""
    known = F.concat_ws(", ", F.nullif(age, F.lit("")), F.nullif(gender, F.lit("")), F.nullif(occupation, F.lit("")))
    return F.when(known == "", F.lit("A person.")).otherwise(F.concat(F.lit("A person: "), known, F.lit(".")))


def transcript_text(generated: Column, manual: Column, missing: str = "Not available.") -> Column:
    """Snippets (array<struct<text>>) as one line: the generated ones, else the manual ones, else a sentinel."""
    line = lambda snippets: F.nullif(F.replace(F.array_join(F.transform(snippets, lambda s: s["text"]), " "), F.lit("\n"), F.lit(" ")), F.lit(""))
    return F.coalesce(line(generated), line(manual), F.lit(missing))


def has_comments(count: Column, responses: Column) -> Column:
    return F.coalesce(count, F.size(responses), F.lit(0)) > 0
