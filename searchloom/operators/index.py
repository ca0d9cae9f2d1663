"""The inverted index as tables: postings, document info and counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import document_text, normalize, normalizer as normalizer_of


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf), doc_info(doc_id, length, ...), and what is counted from them; ``normalizer`` names what made the terms, and ``written`` tells that both are files, to be read again and again."""

    postings: DataFrame
    doc_info: DataFrame
    normalizer: str = field(default="spanish", kw_only=True)
    written: bool = field(default=False, kw_only=True)

    def stats(self) -> DataFrame:
        """One row: documents, vocabulary, tokens."""
        vocabulary = self._terms().agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("cf"), F.lit(0)).cast("long").alias("tokens"))
        return self.doc_info.agg(F.count("*").alias("documents")).crossJoin(vocabulary)  # one row by one row

    def collection(self) -> DataFrame:
        """(term, cf, df, p): the collection's language model."""
        total = self.doc_info.agg(F.sum("length").alias("total"))
        return self._terms().crossJoin(F.broadcast(total)).select("term", "cf", "df", (F.col("cf") / F.col("total")).alias("p"))  # total is one row

    def _terms(self) -> DataFrame:
        """(term, cf, df)"""
        return self.postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))

    def terms_of(self, docs: DataFrame) -> DataFrame:
        """The terms of some documents (doc_id, weight, ...), with the documents' columns."""
        return self.postings.join(docs, "doc_id")

    def info_of(self, docs: DataFrame) -> DataFrame:
        """Some documents (doc_id, rank, ...) with their info."""
        return docs.join(self.doc_info, "doc_id")

    def save(self, path: str) -> None:
        """As a new generation of the path, laid out for queries (``stored``)."""
        from .stored import StoredIndex

        StoredIndex.write(self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The latest generation; raises FileNotFoundError where there is none."""
        from .stored import StoredIndex

        return StoredIndex.open(spark, path)


def document_id(id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(id.cast("string"), F.lit("")), F.nullif(url, F.lit("")), F.lit(""))


def latest(docs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of every key by ``order``; extra columns pass through."""
    place = Window.partitionBy(key).orderBy(*(c.desc_nulls_last() for c in order))
    return docs.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def tokenized(docs: DataFrame, language: str = "spanish", contractions: bool = False, normalizer: str | None = None) -> DataFrame:
    """Canonical documents with doc_id and tokens, by the ``normalizer`` of that name if one is given."""
    text = document_text(F.col("title"), F.col("content"))
    tokens = normalizer_of(normalizer)(text) if normalizer else normalize(text, language, contractions)
    return docs.withColumn("doc_id", document_id(F.col("id"), F.col("url"))).withColumn("tokens", tokens)


def build_index(docs: DataFrame, language: str = "spanish", contractions: bool = False, normalizer: str | None = None) -> Index:
    """Indexes canonical documents of unique ids; documents without a token are left out.

    One shuffle, of the texts by document, whose terms are then counted in place;
    lengths are known where the document is read.  ``normalizer``: the name of
    another than the language's own.
    """
    named = docs.select("title", "content", document_id(F.col("id"), F.col("url")).alias("id")).withColumn("url", F.lit(""))
    dealt = tokenized(named.repartition("id"), language, contractions, normalizer).withColumn("doc_id", F.col("id"))
    postings = dealt.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf")
    return Index(postings, info_of_tokens(tokenized(docs, language, contractions, normalizer)), normalizer=normalizer or language)


def index_of_tokens(words: DataFrame, normalizer: str = "spanish", bucketed: bool = False) -> Index:
    """The index of ``tokenized`` documents; who uses both tables writes these first, so that no text is normalised twice.

    Tokens are dealt out by document, unless they lie in buckets of documents, and counted in place.
    """
    few = words.select("doc_id", "tokens")
    dealt = few if bucketed else few.repartition("doc_id")
    postings = dealt.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf")
    return Index(postings, info_of_tokens(words), normalizer=normalizer)


def info_of_tokens(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.size("tokens").cast("long").alias("length"), "title", "url", "source", "date", "tags", "category").where("length > 0")


def merge_index(old: Index, docs: DataFrame, language: str = "spanish", contractions: bool = False) -> Index:
    """The index after ``docs`` came: a document that was indexed before is replaced; of several of one id the last by title and content counts."""
    named = latest(docs.withColumn("doc_id", document_id(F.col("id"), F.col("url"))), "doc_id", [F.col("title"), F.col("content")])
    own = None if old.normalizer == language else old.normalizer
    new = build_index(named, language, contractions, own)
    ids = named.select("doc_id")
    keep = lambda rows: rows.join(ids, "doc_id", "left_anti").select(*rows.columns)
    return Index(keep(old.postings).unionByName(new.postings), keep(old.doc_info).unionByName(new.doc_info), normalizer=old.normalizer)
