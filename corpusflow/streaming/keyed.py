"""Summary triggers with keyed state: two counters per conversation, dropped when it falls silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRIGGERS = "conv_id long, turn long, user_turns long, n_messages long"
#: Setting and class of the state store that keyed processors need.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


class TriggerProcessor(StatefulProcessor):
    """Numbers the messages of a conversation and gives out those at which a summary is due.

    A conversation whose last message is ``idle_ms`` older than the watermark
    loses its counters; without ``idle_ms`` none does.
    """

    def __init__(self, every: int, min_messages: int, idle_ms: int | None = None):
        self.every, self.min_messages, self.idle_ms = every, min_messages, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "users long, messages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        users, messages = self.counts.get() if self.counts.exists() else (0, 0)
        # Eight bytes and a flag for each message that the conversation has in this batch.
        parts, last = [], 0
        for frame in rows:
            parts.append(frame[["turn", "is_user"]])
            if self.idle_ms is not None:
                last = max(last, int(frame["at"].max()))
        held = pd.concat(parts)
        held = held.sort_values(["turn", "is_user"], na_position="first", kind="stable")
        said = held["is_user"].astype("int64")
        numbered = pd.DataFrame({
            "conv_id": pd.array([key[0]] * len(held), dtype="Int64"),
            "turn": held["turn"].astype("Int64").to_numpy(),
            "user_turns": users + said.cumsum().to_numpy(),
            "n_messages": messages + 1 + pd.RangeIndex(len(held)).to_numpy(),
        })
        self.counts.update((users + int(said.sum()), messages + len(held)))
        if self.idle_ms is not None:
            timers = list(self.handle.listTimers())
            for timer in timers:
                self.handle.deleteTimer(timer)
            # An old batch that comes late does not bring the end nearer.
            self.handle.registerTimer(max([last + self.idle_ms, *timers]))
        due = (said.to_numpy() == 1) & (numbered["user_turns"] % self.every == 0) & (numbered["n_messages"] >= self.min_messages)
        yield numbered[due]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_triggers(
    messages: DataFrame, every: int, min_messages: int, ts: str | None = None, idle_ms: int = 30 * DAY_MS, delay: str = "1 day"
) -> DataFrame:
    """conv_id, turn, user_turns, n_messages of a message stream's trigger points, by keyed state.

    The state is two numbers per conversation. With a time column ``ts`` it ends
    by a timer: once the watermark is ``idle_ms`` past a conversation's last
    message, it is forgotten and starts from zero if it goes on; messages without
    a time, or later than ``delay``, are not counted. Without ``ts`` every message counts and
    state is kept. Messages of one batch are taken in the order of their turns
    (nulls first), later batches come after earlier ones.

    A conversation's messages of one batch meet in one task, as a number and a
    flag each; where a single conversation has more of them than a task holds,
    bound the batches (``max_files``) or use ``jobs.TriggerCounter``, which
    splits conversations.
    """
    columns = [
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role") == "user", F.lit(False)).alias("is_user"),
    ]
    if ts is None:
        slim, processor, mode = messages.select(*columns), TriggerProcessor(every, min_messages), "None"
    else:
        timed = messages.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
        slim = timed.select(*columns, F.col(ts), F.unix_millis(ts).alias("at"))
        processor, mode = TriggerProcessor(every, min_messages, idle_ms), "EventTime"
    return slim.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=TRIGGERS, outputMode="Append", timeMode=mode
    )


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside use the state store for keyed processors; others keep theirs."""
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE_SETTING)
        else:
            spark.conf.set(STORE_SETTING, before)
