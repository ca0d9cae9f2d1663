"""Seen keys as the state of a stream, begun from the log of earlier sessions.

A session's state is keyed by the item's key, so it is dealt out over executors
and checkpointed with the stream's offsets: a restart neither loses nor repeats an
item.  A new session (a new checkpoint) begins with what the log holds.  With a
time to live a key counts as new again once so long has passed since it was seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ship
from .crawl import remember, remembered

#: What the state store must be, for state of this kind.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first item of a key pass, unless its key was seen."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, n, first = self.seen.exists(), 0, None
        for frame in rows:
            n += len(frame)
            first = frame.iloc[:1] if first is None and len(frame) else first
        if not known:
            self.seen.update((n,))
            if first is not None:
                yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((0,))

    def close(self) -> None:
        pass


def session_stream(items: DataFrame, log: str, path: str, checkpoint: str, key: str = "url", ttl_seconds: float | None = None) -> StreamingQuery:
    """Appends to ``path`` each item whose key neither this stream nor an earlier session saw, and its key to the log; items without a key pass.

    A batch's items are written under its number, so one that is run again
    overwrites its own; keys that the log has twice do no harm.
    """
    spark = items.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Clocks alone start no batch, or a stream with a time to live would never end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    named = F.coalesce(F.col(key), F.lit("")) != ""
    before = remembered(spark, log, key).distinct().groupBy(key)
    ttl_ms = None if ttl_seconds is None else int(ttl_seconds * 1000)
    time_mode = "None" if ttl_ms is None else "ProcessingTime"
    first = lambda frames: (f.drop_duplicates(key) for f in frames)  # noqa: E731  of a batch of rows, before they are sent
    new = items.where(named).mapInPandas(first, items.schema).groupBy(key).transformWithStateInPandas(FirstOfKey(ttl_ms), items.schema, "Append", time_mode, before)
    passed = new.unionByName(items.where(~named))

    def write(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(out)
        remember(batch.sparkSession.read.schema(items.schema).parquet(out), log, key)

    return passed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
