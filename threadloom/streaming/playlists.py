"""Completeness of playlists as a stream: one answer a playlist, when its last item has come or its time is up."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = StructType([StructField("list_id", StringType()), StructField("items", LongType()), StructField("have", LongType()), StructField("state", StringType())])


class Completeness(StatefulProcessor):
    """Counts a playlist's distinct items: `complete` once as many have come as are expected, `incomplete` when the
    timer of its first item ends, `late` for each later item of a playlist that has been answered for."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "item string", "times long")
        self.about = handle.getValueState("about", "items long, have long, answered boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        items, have, answered = self.about.get() if self.about.exists() else (0, 0, False)
        fresh, late = not self.about.exists(), 0
        begins = None
        for pdf in rows:
            items = max(items, int(pdf["items"].max()))
            begins = min(x for x in (begins, int(pdf["ms"].min())) if x is not None)
            for item in pdf["item"]:
                if not self.seen.containsKey((item,)):
                    self.seen.updateValue((item,), (1,))
                    have += 1
                    late += answered
        if fresh:
            self.handle.registerTimer(begins + self.wait)
        out = [(key[0], items, have, "late")] * late
        if have >= items and not answered:
            out.append((key[0], items, have, "complete"))
            answered = True
        self.about.update((items, have, answered))
        yield pd.DataFrame(out, columns=[f.name for f in OUT])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        items, have, answered = self.about.get()
        self.about.update((items, have, True))
        yield pd.DataFrame([] if answered else [(key[0], items, have, "incomplete")], columns=[f.name for f in OUT])

    def close(self) -> None:
        """Nothing to close."""


def completeness(stream: DataFrame, wait: int, delay: str = "0 seconds") -> DataFrame:
    """(list_id, items, have, state) of a stream (list_id, item, items: how many are expected, ts): see Completeness.

    wait: seconds after a playlist's first item. State is kept by key; the session needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("list_id").transformWithStateInPandas(Completeness(wait * 1000), OUT, "Append", "EventTime")
