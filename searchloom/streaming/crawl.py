"""Structured Streaming: stamp, drop what was seen, append; upserts and index merges by micro-batch."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import Index, document_id, index_of_tokens, latest, tokenized
from ..session import settled

#: Registers of a generation's sketch of its terms, as a power of two: an error of 0.4 %.
SKETCH_BITS = 16


def stamped(items: DataFrame, now: Column | None = None) -> DataFrame:
    """Items with the time they were scraped at, as a string."""
    return items.withColumn("scraped_at", F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))


def unseen(items: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first item of every key, in a stream or a batch; items whose keys are all null or empty pass.

    State holds every key, exactly; with ``event_time`` and ``delay`` it is
    bounded, and a key that comes again after the delay counts as new.
    """
    has_key = F.lit(False)
    for k in keys:
        has_key = has_key | (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    if event_time and delay:
        items = items.withWatermark(event_time, delay)
        first = items.where(has_key).dropDuplicatesWithinWatermark(keys)
    else:
        first = items.where(has_key).dropDuplicates(keys)
    return first.unionByName(items.where(~has_key))


def not_in(items: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Items whose key no earlier session logged; items without one pass."""
    log = seen.where(F.coalesce(F.col(key), F.lit("")) != "").select(key)
    return items.join(log, key, "left_anti").select(*items.columns)


def remember(items: DataFrame, log: str, key: str = "url") -> None:
    """Adds a session's keys to the log of seen ones, at its end."""
    items.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).cast("string").alias(key)).distinct().write.mode("append").parquet(log)


def remembered(spark: SparkSession, log: str, key: str = "url") -> DataFrame:
    """The keys of all earlier sessions; a log that isn't there is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"`{key}` string")
    return spark.read.schema(f"`{key}` string").parquet(log)


def _least(items: DataFrame, key: str) -> DataFrame:
    """One item a key, the least by its other columns (nulls last, maps aside); items without a key pass."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    order = [F.col(f.name).asc_nulls_last() for f in items.schema if f.name != key and not re.search("map<|variant", f.dataType.simpleString())]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(order or [F.lit(0)])))
    first = items.where(named).withColumn("_place", place).where("_place = 1").drop("_place")
    return first.unionByName(items.where(~named))


def session(items: DataFrame, log: str, key: str = "url") -> DataFrame:
    """What is new of a batch of items: each key once, its least item, none that an earlier session logged; writes the log before it returns."""
    spark = items.sparkSession
    path = f"{log.rstrip('/')}-items/{uuid.uuid4().hex}"
    _least(not_in(items, remembered(spark, log, key), key), key).write.parquet(path)
    new = spark.read.schema(items.schema).parquet(path)
    remember(new, log, key)
    return new


def append(items: DataFrame, path: str, checkpoint: str, format: str = "json", partition_by: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """Appends a stream to files; the checkpoint makes restarts exact."""
    writer = items.writeStream.format(format).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def crawl(items: DataFrame, path: str, checkpoint: str, key: str = "url", now: Column | None = None, **options) -> StreamingQuery:
    """The stages in order: stamp, drop what was seen, append."""
    return append(unseen(stamped(items, now), [key]), path, checkpoint, **options)


def upsert_each_batch(items: DataFrame, base: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Keeps versions of a table under ``base``: each micro-batch writes the next, in which its rows win by ``key``.

    A batch that is run again overwrites its own version, so retries are exact.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.col(c) for c in batch.columns if c != key]
        fresh = latest(batch, key, order)
        if number:
            old = spark.read.parquet(f"{base}/v{number - 1}")
            fresh = old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{base}/v{number}")

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_deltas(items: DataFrame, base: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Upserts that rewrite nothing: each micro-batch adds its own rows; ``load_deltas`` reads the last row of every key."""

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, key, [F.col(c) for c in batch.columns if c != key]).write.mode("overwrite").parquet(f"{base}/generation={number}")

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_deltas(spark: SparkSession, base: str, key: str = "doc_id") -> DataFrame:
    """The table that all deltas make; only keys and generations are shuffled to find each key's last."""
    rows = spark.read.parquet(base)
    last = rows.groupBy(key).agg(F.max("generation").alias("generation"))
    return rows.join(last, [key, "generation"], "left_semi").drop("generation")


def compact_deltas(spark: SparkSession, base: str, out: str, key: str = "doc_id") -> None:
    """Writes the table that all deltas make as the only generation of ``out``."""
    load_deltas(spark, base, key).write.parquet(f"{out}/generation=0")


def index_each_batch(docs: DataFrame, base: str, checkpoint: str, language: str = "spanish") -> StreamingQuery:
    """Adds each micro-batch's documents to an index as one more generation; ``load_generations`` reads them all.

    Nothing that exists is rewritten.  A document that comes again counts from
    its last generation alone: of every generation the ids are kept too, those
    of documents without a token included.  Each generation keeps a sketch of its
    terms, which ``sketched_stats`` unites.
    """

    def add(batch: DataFrame, number: int) -> None:
        # The last of a batch's documents of one id, by title and content.
        last = latest(batch.withColumn("doc_id", document_id(F.col("id"), F.col("url"))), "doc_id", [F.col("title"), F.col("content")])
        words = settled(tokenized(last, language).select("doc_id", "tokens", "title", "url", "source", "date", "tags", "category"), "words")  # three tables come from them
        index = index_of_tokens(words)
        for name, table in (("postings", index.postings), ("doc_info", index.doc_info), ("ids", words.select("doc_id"))):
            table.write.mode("overwrite").parquet(f"{base}/{name}/generation={number}")
        own = batch.sparkSession.read.parquet(f"{base}/postings/generation={number}")
        counted = own.agg(F.hll_sketch_agg("term", F.lit(SKETCH_BITS)).alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("postings"))
        counted.write.mode("overwrite").parquet(f"{base}/sketches/generation={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_generations(spark: SparkSession, base: str) -> Index:
    """The index of all generations, each document as it came last."""
    ids = spark.read.parquet(f"{base}/ids")
    last = ids.groupBy("doc_id").agg(F.max("generation").alias("last"))
    # Of known size, so that Spark moves what came again, and not the postings, where that is little.
    replaced = settled(ids.join(last, "doc_id").where("generation < last").select("doc_id", "generation").distinct(), "replaced")

    def current(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{base}/{name}")
        return rows.join(replaced, ["doc_id", "generation"], "left_anti").select(*(c for c in rows.columns if c != "generation"))

    return Index(current("postings"), current("doc_info"))


def sketched_stats(spark: SparkSession, base: str) -> DataFrame:
    """(generation, vocabulary, tokens, postings): estimates over all generations up to each, from a row a generation; no posting is read.

    Tokens and postings count a document as often as it came.
    """
    rows = spark.read.schema("terms binary, tokens long, postings long, generation int").parquet(f"{base}/sketches")
    before = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # a row a micro-batch
    united = F.hll_sketch_estimate(F.hll_union_agg("terms").over(before))
    return rows.select("generation", united.alias("vocabulary"), F.sum("tokens").over(before).alias("tokens"), F.sum("postings").over(before).alias("postings"))


def read_stream(spark: SparkSession, table: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over a Parquet table that is one file among others, or a folder."""
    schema = spark.read.parquet(table).schema
    folder, _, name = table.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(table)
