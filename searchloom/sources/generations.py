"""Folders that change as a whole: each write makes a generation, and one small file more names the latest.

A reader keeps to the generation it opened while the next one is written, so a
collection can be saved to the path that it was opened from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Row, SparkSession, functions as F

_NAMES = "number long, folder string, properties map<string,string>"


def begin(path: str) -> str:
    """A new folder for a generation's tables; nobody reads it until it is published."""
    return f"{path.rstrip('/')}/generations/{uuid.uuid4().hex}"


def current(spark: SparkSession, path: str) -> Row | None:
    """(number, folder, properties) of the latest generation; None where there is none."""
    names = f"{path.rstrip('/')}/published"
    where = spark._jvm.org.apache.hadoop.fs.Path(names)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(_NAMES).parquet(names).orderBy(F.desc("number"), F.desc("folder")).first()


def publish(spark: SparkSession, path: str, folder: str, **properties) -> None:
    """Makes the folder the latest generation."""
    last = current(spark, path)
    row = spark.createDataFrame([(last.number + 1 if last else 0, folder, {k: str(v) for k, v in properties.items()})], _NAMES)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/published")
