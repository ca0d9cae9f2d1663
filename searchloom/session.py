"""What driver and executors share: a folder, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_HASHED = "spark.sql.execution.useObjectHashAggregateExec"
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="searchloom-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine, where the session leaves it unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, not yet created."""
    path = f"{shared_dir(spark)}/searchloom/{name}-{uuid.uuid4().hex}"
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``fresh_dir`` that nothing reads any more."""
    for path in paths:
        name, _, number = path.rpartition("/")[2].rpartition("-")
        spark.sql(f"DROP TABLE IF EXISTS `searchloom_{name}_{number}`")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All that is written to fresh folders meanwhile is deleted at the end: for work whose result lies elsewhere."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        discard(spark, *made)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of what is written meanwhile go with each write."""
    return _setting(spark, _CLEANUP, "true")


def sums_in_order(spark: SparkSession) -> AbstractContextManager[None]:
    """Lists that are collected by key meanwhile, of rows sorted by it, are collected as the rows come; nothing is hashed, spilled and sorted anew."""
    return _setting(spark, _HASHED, "false")


def joins_in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written meanwhile and lies in equal buckets of one join key isn't shuffled by all of them."""
    return _setting(spark, _ALL_KEYS, "false")


def settled(rows: DataFrame, name: str) -> DataFrame:
    """Rows written and read back: computed once, and of a size that Spark knows when it plans joins."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, name)
    with brief_shuffles(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def in_buckets(rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Rows written to the shared folder by buckets of a key, and read as a table of the session: joins and sums by the key need no shuffle."""
    spark, path = rows.sparkSession, path or fresh_dir(rows.sparkSession, name)
    table = f"searchloom_{name}_{path.rpartition('-')[2]}"
    with brief_shuffles(spark):
        rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


@lru_cache(maxsize=1)
def _package() -> str:
    """This package as a zip file."""
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="searchloom-")) / "searchloom.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    return str(out)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once a context, so that it need not be installed there."""
    context = spark.sparkContext
    if not getattr(context, "_searchloom_shipped", False):
        context.addPyFile(_package())
        context._searchloom_shipped = True
