"""A saved index that reads what a query needs: its terms' posting blocks, its hits' documents.

Documents are put into ranges of nearly one length, of ``RANGE`` documents or as many
as make about ``RANGES`` of them, so that a query meets no more blocks of a term than that.  A row
of ``blocks`` is a term's postings in one range, with their number, the greatest
tf and the least length, so that a bound of any score in the range needs no
posting.  Blocks lie in folders by a hash of the term, documents and their terms in
folders by a hash of the doc_id, each sorted within; both numbers of folders follow
from the sizes.  Joins by (folder, key) prune folders by what the other side holds,
and a key's rows are few row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import brief_shuffles, scratch, settled, sums_in_order
from ..sources import generations
from .index import Index

#: Documents of a range at least, ranges that their size aims at, and postings of a folder (documents: a fifth) that its number aims at.
RANGE, RANGES, FOLDER_ROWS, MOST_FOLDERS = 16, 1024, 100_000, 8192
#: Postings that a task sorts.
TASK_ROWS = 500_000
#: Tasks that write a folder of documents' terms at most.
SALTS = 16
#: Columns of a posting in a block.
_POSTING = ("doc_id", "tf", "length", "category")


def folder_of(key: Column, folders: int) -> Column:
    return F.pmod(F.hash(key), F.lit(folders))


def _folders(rows: int, each: int) -> int:
    """A power of two."""
    return min(1 << max(rows // each, 1).bit_length() - 1, MOST_FOLDERS)


def _write(rows: DataFrame, path: str, key: str, folders: int, *order: str) -> None:
    """By folder of the key, sorted; ranges of (folder, key, ...) make the files, so that a hot key's rows are several tasks'."""
    dealt = rows.withColumn("folder", folder_of(F.col(key), folders)).repartitionByRange("folder", key, *order)
    dealt.sortWithinPartitions("folder", key, *order).write.partitionBy("folder").parquet(path)


@dataclass(frozen=True)
class StoredIndex(Index):
    """``blocks`` (folder, term, range, n, cf, max_tf, min_length, postings), ``documents`` (folder, doc_id, length, ...) and ``terms`` (folder, doc_id, term, tf)."""

    blocks: DataFrame
    documents: DataFrame
    terms: DataFrame
    term_folders: int
    doc_folders: int

    @classmethod
    def write(cls, index: Index, path: str) -> None:
        """A new generation of the path."""
        spark, folder = index.postings.sparkSession, generations.begin(path)
        with scratch(spark), brief_shuffles(spark):
            term_folders, doc_folders = cls._write_tables(index, folder)
        generations.publish(spark, path, folder, term_folders=term_folders, doc_folders=doc_folders, normalizer=index.normalizer)

    @staticmethod
    def _write_tables(index: Index, folder: str) -> tuple[int, int]:
        """The tables of a generation; the numbers of their folders."""
        info, postings = (index.doc_info, index.postings) if index.written else (settled(index.doc_info, "info"), settled(index.postings, "postings"))
        n_docs, n_postings = info.count(), postings.count()
        term_folders, doc_folders = _folders(n_postings, FOLDER_ROWS), _folders(n_docs, max(FOLDER_ROWS // 5, 1))
        # Tasks are as many as the postings need, however many partitions the session sets, so that none sorts more than its memory holds.
        tasks = max(-(-n_postings // TASK_ROWS), info.sparkSession.sparkContext.defaultParallelism)
        # Ranges of documents by length: partitions by range of length, numbered within.
        place = F.row_number().over(Window.partitionBy("part").orderBy("length", "doc_id")) - 1
        dealt = info.select("doc_id", "length", "category").repartitionByRange("length", "doc_id").withColumn("part", F.spark_partition_id())
        number = (F.col("part").cast("long") * (1 << 32) + F.floor(place / max(RANGE, -(-n_docs // RANGES)))).alias("range")
        ranges = settled(settled(dealt, "lengths").select("doc_id", "length", "category", number), "ranges")
        own = F.collect_list(F.struct(*_POSTING)).alias("postings")  # a range's at most, in the order they are sorted in
        sums = F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")
        # One exchange: a folder's postings, those of a frequent term dealt out by range, are sorted where they arrive, and summed in that order.
        frequent = settled(postings.groupBy("term").agg(F.ceil(F.count("*") / FOLDER_ROWS).alias("tasks")).where("tasks > 1"), "frequent")
        salt = F.pmod(F.xxhash64("range"), F.coalesce("tasks", F.lit(1))).alias("salt")
        salted = postings.join(ranges, "doc_id").join(frequent, "term", "left").select(folder_of(F.col("term"), term_folders).alias("folder"), salt, "term", "range", *_POSTING)
        block = ("folder", "term", "range", "salt")
        with sums_in_order(info.sparkSession):
            blocks = salted.repartition(tasks, "folder", "salt").sortWithinPartitions(*block, "doc_id").groupBy(*block).agg(*sums, own).drop("salt")
            blocks.write.partitionBy("folder").parquet(f"{folder}/blocks")
        _write(info, f"{folder}/documents", "doc_id", doc_folders)
        terms = postings.select(folder_of(F.col("doc_id"), doc_folders).alias("folder"), "doc_id", "term", "tf").repartition(tasks, "folder", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        terms.sortWithinPartitions("folder", "doc_id", "term").write.partitionBy("folder").parquet(f"{folder}/terms")
        return term_folders, doc_folders

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        """Raises FileNotFoundError where no index was saved."""
        found = generations.current(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        info = "doc_id string, length long, title string, url string, source string, date string, tags array<string>, category string"
        posting = "doc_id:string,tf:bigint,length:bigint,category:string"
        read = lambda name, schema: spark.read.schema(f"{schema}, folder int").parquet(f"{found.folder}/{name}")
        blocks = read("blocks", f"term string, range long, n long, cf long, max_tf long, min_length long, postings array<struct<{posting}>>")
        documents, terms = read("documents", info), read("terms", "doc_id string, term string, tf long")
        postings = blocks.select("term", F.inline("postings")).select("term", "doc_id", "tf")
        return cls(postings, documents.drop("folder"), blocks, documents, terms, int(found.properties["term_folders"]), int(found.properties["doc_folders"]), normalizer=found.properties["normalizer"])

    def _terms(self) -> DataFrame:
        return self.blocks.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("n").alias("df"))

    def with_folder(self, rows: DataFrame, key: str, folders: int) -> DataFrame:
        return rows.withColumn("folder", folder_of(F.col(key), folders))

    def blocks_of(self, terms: DataFrame, parts: int) -> DataFrame:
        """``terms`` (term, weight, ...) with their blocks, in so many parts; only their folders are read.

        A term of weight 0 adds nothing and is left out.  The blocks are dealt out by
        range before each meets the queries that ask for it: frequent terms are many
        tasks' work, and a document's postings are one's.
        """
        asked = terms.where("weight > 0")
        return self.distinct_blocks(asked).repartition(parts, "range").join(asked, "term")

    def distinct_blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of the distinct terms of a table, each once; only their folders are read."""
        # The condition lets Spark take the terms for a filter of folders.
        asked = self.with_folder(settled(terms.select("term").distinct(), "asked").where("term <> ''"), "term", self.term_folders)
        return self.blocks.join(asked, ["folder", "term"]).drop("folder")

    def terms_of(self, docs: DataFrame) -> DataFrame:
        """The terms of some documents (doc_id, weight, ...), with the documents' columns; only their folders are read."""
        asked = self.with_folder(docs.where("weight > 0"), "doc_id", self.doc_folders)
        return self.terms.join(asked, ["folder", "doc_id"]).drop("folder")

    def info_of(self, docs: DataFrame) -> DataFrame:
        """Some documents (doc_id, rank, ...) with their info."""
        asked = self.with_folder(docs.where(F.col("rank") > 0), "doc_id", self.doc_folders)
        return self.documents.join(asked, ["folder", "doc_id"]).drop("folder")
