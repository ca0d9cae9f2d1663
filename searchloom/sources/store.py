"""Documents as a columnar store for lookups: category folders, sorted by id, Bloom filters of ids.

A lookup by id pushes an equality to the scan, which reads the row groups whose
range and Bloom filter may hold the id; a category is a folder.  Each save is a
generation of its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import DOCUMENT
from . import generations
from .jsonl import DocumentStore

#: Bytes of a row group, and ids that a file's Bloom filter is sized for.
ROW_GROUP, FILTER_IDS = 16 << 20, 1_000_000


class ColumnarStore(DocumentStore):
    """Canonical documents of unique ids, as they were saved."""

    @classmethod
    def write(cls, documents: DataFrame, path: str, row_group: int = ROW_GROUP) -> ColumnarStore:
        spark, folder = documents.sparkSession, generations.begin(path)
        # Ranges of (category, id): a large category is many tasks' and files.
        rows = documents.select(*DOCUMENT.names).repartitionByRange("category", "id").sortWithinPartitions("category", "id")
        writer = rows.write.partitionBy("category").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", FILTER_IDS).option("parquet.block.size", row_group)
        writer.parquet(folder)
        generations.publish(spark, path, folder)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ColumnarStore:
        """Raises FileNotFoundError where nothing was saved."""
        found = generations.current(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        return cls(spark.read.schema(DOCUMENT).parquet(found.folder))

    def get_many(self, ids: DataFrame) -> DataFrame:
        """The documents of a table (id)."""
        return self.documents.join(ids.select("id").distinct(), "id", "left_semi").select(*DOCUMENT.names)

    def by_category(self) -> DataFrame:
        """Counts from the files' footers and folders alone."""
        return self.documents.groupBy("category").agg(F.count("*").alias("documents"))
