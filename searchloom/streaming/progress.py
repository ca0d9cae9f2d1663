"""A log of streams' batches as a table: a row a batch that a query finished."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

_ROW = "query string, name string, batch long, at string, rows_in long, rows_per_second double, duration_ms long, state_rows long, sources string, ended string"


class ProgressLog(StreamingQueryListener):
    """Appends every batch's progress to JSON files under ``path``, and a query's end with its error, if it had one.

    The driver writes a small file an event; ``progress`` reads them as a table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, row: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        out = target.getFileSystem(conf).create(target)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._append({
            "query": str(p.id), "name": p.name, "batch": p.batchId, "at": p.timestamp, "rows_in": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "duration_ms": p.durationMs.get("triggerExecution"),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "sources": "; ".join(s.description for s in p.sources),
        })

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._append({"query": str(event.id), "ended": event.exception or "done"})


def log_progress(spark: SparkSession, path: str) -> ProgressLog:
    """Begins to log every stream of the session; ``spark.streams.removeListener`` ends it."""
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    return log


def wait_for_end(spark: SparkSession, path: str, query: str, seconds: float = 30) -> bool:
    """Whether the end of a query was logged, which happens a moment after it."""
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and not progress(spark, path).where(F.col("ended").isNotNull() & (F.col("query") == str(query))).isEmpty():
            return True
        time.sleep(0.2)
    return False


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(query, name, batch, at, rows_in, ..., ended) of all that was logged."""
    return spark.read.schema(_ROW).json(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(query, batches, rows_in, ended) of each stream; a batch that is reported twice counts once."""
    rows = progress(spark, path)
    batches = rows.where("batch is not null").groupBy("query", "batch").agg(F.max("rows_in").alias("rows_in"))
    ended = rows.groupBy("query").agg(F.max("ended").alias("ended"))
    return batches.where("rows_in > 0").groupBy("query").agg(F.count("*").alias("batches"), F.sum("rows_in").alias("rows_in")).join(ended, "query")
