"""JSON-lines collections: scan, canonical documents, last write wins, snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.detect import sink_category
from ..operators.index import latest
from ..schema import CATEGORIES, CRAWL_ITEM, DOCUMENT
from ..session import ship

#: Stands for no tags.
NO_TAGS = "Unknowns"
_CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or a file that the pattern matches, is there, on any file system Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def raw_lines(spark: SparkSession, directory: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """All lines of the JSON-lines files under ``<directory>/<category>``: category, path, block, at, value.

    Large files are split among tasks.  ``block`` is where in its file a task's
    split begins, and ``at`` counts on within it, so (path, block, at) is the
    lines' order.  A missing category has no lines.
    """
    out = spark.createDataFrame([], "category string, path string, block long, at long, value string")
    for category in categories:
        folder = f"{directory}/{category}"
        if path_exists(spark, folder):
            # Files of JSON lines in the folder and below it, as the crawl sink writes them.
            files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").option("lineSep", "\n").text(folder)
            place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
            out = out.unionByName(files.select(F.lit(category).alias("category"), *place, "value"))
    return out


def filled(lines: DataFrame) -> DataFrame:
    """Lines without the white space around them, and without blank ones."""
    return lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where("value <> ''")


def numbered(lines: DataFrame, raw: DataFrame) -> DataFrame:
    """category, path, line_no, value of some lines: their numbers in their files.

    Counts the lines of every block of ``raw``; a row a block is joined.
    """
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(blocks, ["path", "block"]).select("category", "path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, malformed): parsed lines with their place, and those that are no JSON object with their file and line number."""
    schema = StructType([*CRAWL_ITEM.fields, StructField(_CORRUPT, StringType())])
    parsed = filled(raw).withColumn("item", F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    bad = F.col(f"item.{_CORRUPT}").isNotNull() | F.col("item").isNull()
    return parsed.where(~bad), numbered(parsed.where(bad).drop("item"), raw)


def python_id(raw: pd.Series) -> pd.Series:
    """UUIDs, version 5, of items without a url: of their JSON with sorted keys, as Python writes it."""
    return raw.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(json.loads(x), sort_keys=True))))


def canonical(items: DataFrame) -> DataFrame:
    """Canonical documents of parsed items, with the columns of their place."""
    ship(items.sparkSession)
    raw_id = F.pandas_udf(python_id, "string")
    i = lambda name: F.col(f"item.{name}")
    text = lambda c: F.coalesce(c, F.lit(""))
    # Only items without a url reach Python.
    missing = items.where(text(i("url")) == "").withColumn("id", raw_id("value"))
    named = items.where(text(i("url")) != "").withColumn("id", i("url")).unionByName(missing)
    return named.select(
        "id", text(i("url")).alias("url"), text(i("title")).alias("title"), text(i("content")).alias("content"), i("author"), i("date"), i("scraped_at"),
        text(i("source")).alias("source"), F.when(F.size(i("tags")) > 0, i("tags")).otherwise(F.array(F.lit(NO_TAGS))).alias("tags"),
        "category", text(i("category")).alias("subcategory"), i("brand"), i("os"), i("device_name"), i("article_type"), "path", "block", "at",
    )


def _rank(category: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), category)


class DocumentStore:
    """Canonical documents of unique ids."""

    def __init__(self, documents: DataFrame, malformed: DataFrame | None = None):
        self.documents, self.malformed = documents, malformed

    @classmethod
    def load(cls, spark: SparkSession, directory: str, categories: tuple[str, ...] = CATEGORIES) -> DocumentStore:
        """All categories, or some: of equal ids the later category, file and line counts."""
        items, malformed = parse(raw_lines(spark, directory, categories))
        docs = latest(canonical(items), "id", [_rank(F.col("category")), F.col("path"), F.col("block"), F.col("at")])
        return cls(docs.select(*DOCUMENT.names), malformed)

    def get(self, id: str) -> DataFrame:
        return self.documents.where(F.col("id") == id)

    def in_category(self, category: str) -> DataFrame:
        return self.documents.where(F.col("category") == category)

    def by_category(self) -> DataFrame:
        return self.documents.groupBy("category").agg(F.count("*").alias("documents"))

    def __iter__(self) -> Iterator:
        return self.documents.toLocalIterator()

    def save_snapshot(self, path: str) -> None:
        """JSON lines with nulls kept."""
        self.documents.write.mode("overwrite").json(path, ignoreNullFields=False)

    @classmethod
    def from_snapshot(cls, spark: SparkSession, path: str) -> DocumentStore:
        """No defaults are applied again; a malformed line fails the read."""
        return cls(spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path))


def append_items(items: DataFrame, directory: str, spider: str, date: Column | None = None) -> None:
    """Appends crawl items under ``<directory>/<category>``, the category by the spider's name."""
    folder = items.sparkSession.range(1).select(sink_category(F.lit(spider)).alias("c")).first().c
    rows = items.withColumn("spider", F.lit(spider)).withColumn("crawl_date", date if date is not None else F.current_date())
    rows.write.mode("append").partitionBy("spider", "crawl_date").json(f"{directory}/{folder}", ignoreNullFields=False)
