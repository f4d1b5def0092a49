"""An ordered event log by key: events get the next number of their key as they arrive, and readers follow with a
cursor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT = 100
NUMBERED = "key string, sequence long, event_id string, ts timestamp, payload string"


class Numbering(StatefulProcessor):
    """The last number of a key and the ids of its last REMEMBERED events: one of those that is delivered again gets no
    second number. The number is never forgotten, so numbers never start again."""

    REMEMBERED = 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("numbering", "n long, ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, ids = self.state.get() if self.state.exists() else (0, [])
        new = pd.concat(list(rows)).drop_duplicates("event_id").sort_values(["ts", "event_id"])
        new = new[~new["event_id"].isin(set(ids))]
        new = new.assign(sequence=range(number + 1, number + 1 + len(new)))
        self.state.update((number + len(new), [*ids, *new["event_id"]][-self.REMEMBERED :]))
        yield new[["key", "sequence", "event_id", "ts", "payload"]]

    def close(self) -> None:
        pass


def numbered(events: DataFrame) -> DataFrame:
    """A stream of events (key, event_id, ts, payload) with their numbers. In a batch events of a key come by time. Needs the
    RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Numbering(), outputStructType=NUMBERED, outputMode="Append", timeMode="None")


def poll(log: DataFrame, cursors: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What each reader (key, cursor) gets next from the retained log (key, sequence, ...): at most `limit` events after its
    cursor. A cursor from before the first retained event is reset to it."""
    kept = log.groupBy("key").agg(F.min("sequence").alias("first"))
    asked = cursors.join(kept, "key").withColumn("reset", F.col("cursor") + 1 < F.col("first"))
    asked = asked.withColumn("start", F.when(F.col("reset"), F.col("first") - 1).otherwise(F.col("cursor"))).drop("first")
    return log.join(asked, "key").filter((F.col("sequence") > F.col("start")) & (F.col("sequence") <= F.col("start") + limit)).drop("start")
