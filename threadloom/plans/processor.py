"""The processor end to end: filter, normalise, personas, split, write."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.jsonops import metadata_or_empty, normal_prompt
from threadloom.operators import activity, history, personas, splits

ORDER = ["timestamp", "post_id"]
KEY = ["user_id", "timestamp", "post_id", "completion"]


@dataclass(frozen=True)
class Config:
    least: int = 1
    most: int = 1 << 30
    history: int = 0
    drop_history: bool = False
    mode: str = "user"  # user, post or turn
    unseen: float = 0.1
    seen: float = 0.1
    val: float = 0.1
    seed: int = 42
    fraction: float = 1.0
    turns: tuple[int, int, int] = (2, 10, 1)  # least, most, least for train
    row_filter: Column | None = None
    complete: Callable[[DataFrame], DataFrame] | None = None
    provider: personas.Provider = field(default=personas.from_statistics)

    def __post_init__(self):
        if not 0 <= self.val + self.seen < 1 or not 0 <= self.unseen < 1 or not 0 < self.fraction <= 1:
            raise ValueError("fractions must lie in [0, 1), val and seen together too")
        if self.drop_history and self.least <= self.history:
            raise ValueError("least must exceed the history that is dropped")


def read_config(path: str, **hooks) -> Config:
    """A Config from a YAML or JSON file of its fields; row_filter is SQL. Functions come as `hooks`."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML config needs PyYAML; JSON needs nothing") from e
        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {unknown}")
    if "turns" in given:
        given["turns"] = tuple(given["turns"])
    if given.get("row_filter"):
        given["row_filter"] = F.expr(given["row_filter"])
    return Config(**given, **hooks)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Without the helper columns that `df` has of those named."""
    return df.drop(*set(names) & set(df.columns))


def prepared(df: DataFrame, config: Config) -> DataFrame:
    """Sampled, filtered and normalised interactions with their turn_id."""
    if config.fraction < 1:
        df = splits.sample_rows(df, config.fraction, config.seed, KEY)
    df = activity.active_rows(df, config.least, config.most, predicate=config.row_filter)
    df = df.withColumn("prompt", normal_prompt(F.col("prompt"))).withColumn("metadata", metadata_or_empty(F.col("metadata")))
    if config.complete:
        df = df.transform(config.complete)
    return df.withColumn("turn_id", F.size("prompt"))


def split(df: DataFrame, config: Config) -> DataFrame:
    if config.mode == "user":
        return splits.split_by_user(df, config.unseen, config.seen, config.val, config.seed, ORDER, KEY)
    if config.mode == "post":
        return splits.train_users_only(splits.split_by_post_time(df, config.unseen, config.val))
    if config.mode == "turn":
        least, most, train = config.turns
        return splits.split_by_turn(df, least, most, config.unseen, config.val, train)
    raise ValueError(f"no mode {config.mode}")


def process(df: DataFrame, config: Config) -> DataFrame:
    """Interactions with persona and split. By post, personas come from train rows alone; else from all rows."""
    rows = prepared(df, config)
    parts = split(rows, config)
    base = parts.where(F.col("split") == "train").drop("split") if config.mode == "post" else rows
    told = config.provider(history.history_text(base, config.history or 1, ORDER))
    if config.drop_history:
        parts = split(history.later_rows(rows, config.history, ORDER).drop("rn"), config)
    return personas.with_personas(parts, told)
