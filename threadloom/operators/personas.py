"""Personas: offline providers, checkpoints and their join. A language model is a provider like any other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.jsonops import persona_or_default
from threadloom.functions.text import tokens
from threadloom.operators.dedupe import upsert_last

#: From (user_id, entries, history) to (user_id, persona).
Provider = Callable[[DataFrame], DataFrame]


def fixed(persona: str) -> Provider:
    return lambda histories: histories.select("user_id", F.lit(persona).alias("persona"))


def statistics(rows: DataFrame, text: str = "completion", user: str = "user_id") -> DataFrame:
    """What a persona says in numbers: texts, and their mean, least and most words."""
    n = F.size(tokens(F.col(text))).cast("long")
    return rows.groupBy(user).agg(F.count(F.lit(1)).alias("texts"), F.avg(n).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def from_statistics(histories: DataFrame) -> DataFrame:
    """A deterministic provider: the persona is the history's size."""
    words = F.size(tokens(F.col("history")))
    lines = F.array(F.concat(F.lit("entries: "), F.col("entries").cast("string")), F.concat(F.lit("words: "), words.cast("string")))
    return histories.select("user_id", F.to_json(F.struct(lines.alias("statistics"))).alias("persona"))


def preview(histories: DataFrame) -> DataFrame:
    """What a provider would be asked, without asking: the size of each history in place of a persona."""
    words = F.size(tokens(F.col("history"))).cast("string")
    return histories.select("user_id", F.concat(F.lit("preview of "), F.col("entries").cast("string"), F.lit(" entries, "), words, F.lit(" words")).alias("persona"))


def calling(call: Callable[[str], tuple[str, dict]], valid: Callable[[str], bool], default: str, tries: int = 5, pause: float = 60.0, at_once: int = 8) -> Provider:
    """A provider that asks `call` (history to persona and usage: usd, prompt_tokens, completion_tokens) from within tasks.

    Each task holds at most `at_once` calls at a time. A call that raises, or whose answer is not valid, is tried again
    after `pause` seconds, `tries` times in all; then the persona is `default`. All tries count as usage. What a lost
    task had asked is asked again, so a run that matters goes batch by batch (stores.PersonaStore)."""

    def ask(history: str) -> tuple[str, float, int, int]:
        spent = [0.0, 0, 0]
        for k in range(tries):
            try:
                answer, usage = call(history)
                spent = [a + b for a, b in zip(spent, (usage.get("usd", 0.0), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)), strict=True)]
                if valid(answer):
                    return answer, *spent
            except Exception:  # whatever a remote call raises is a failed try
                pass
            if k + 1 < tries:
                time.sleep(pause)
        return default, *spent

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in parts:
                answers = list(pool.map(ask, pdf["history"]))
                yield pd.DataFrame({"user_id": pdf["user_id"], "persona": [a[0] for a in answers], "usd": [a[1] for a in answers], "prompt_tokens": [a[2] for a in answers], "completion_tokens": [a[3] for a in answers]})

    def provide(histories: DataFrame) -> DataFrame:
        kind = histories.schema["user_id"].dataType.simpleString()
        told = histories.select("user_id", F.coalesce("history", F.lit("")).alias("history"))
        out = told.mapInPandas(batches, f"user_id {kind}, persona string, usd double, prompt_tokens long, completion_tokens long")
        return out.select("user_id", "persona", F.struct("usd", "prompt_tokens", "completion_tokens").alias("usage"))

    return provide


def pending(histories: DataFrame, done: DataFrame) -> DataFrame:
    """Users whose persona no checkpoint has."""
    return histories.join(done.select("user_id"), "user_id", "left_anti")


def merged(checkpoint: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert_last(checkpoint, fresh, ["user_id"])


def with_personas(rows: DataFrame, personas: DataFrame) -> DataFrame:
    return rows.join(personas, "user_id", "left").withColumn("persona", persona_or_default(F.col("persona")))


def usage(rows: DataFrame) -> DataFrame:
    """Totals of a provider's usage struct (usd, prompt_tokens, completion_tokens)."""
    return rows.agg(
        F.sum("usage.usd").alias("usd"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"),
        F.sum(F.col("usage.prompt_tokens") + F.col("usage.completion_tokens")).alias("total_tokens"), F.count(F.lit(1)).alias("calls"),
    )
