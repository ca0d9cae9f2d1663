"""TF-IDF vectors in long form, cosine search over them, and collections of texts by such vectors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import document_text, normalizer as normalizer_of
from ..session import settled
from ..sources import generations
from .index import Index, document_id, latest
from .vectors import scalar_columns

#: Fixed value: terms of the vocabulary.
MAX_FEATURES = 15_000
DIGITS = 6


@dataclass(frozen=True)
class TfIdf:
    """vocabulary(term, cf, df, idf) and the vectors(doc_id, term, w) of the documents fitted on."""

    vocabulary: DataFrame
    vectors: DataFrame
    normalizer: str = field(default="spanish", kw_only=True)

    @classmethod
    def fit(cls, index: Index, n_documents: int | DataFrame | None = None, max_features: int = MAX_FEATURES) -> TfIdf:
        """Vocabulary: the terms of largest corpus frequency, ties to the lesser term.  idf = ln((1 + n) / (1 + df)) + 1.

        ``n_documents`` also counts documents without a token; a table is
        counted in the same plan.  Raises ValueError if there is no document at
        all, which takes a look at one row; a number is taken at its word.
        """
        if n_documents == 0 if isinstance(n_documents, int) else (n_documents if n_documents is not None else index.doc_info).isEmpty():
            raise ValueError("no documents to fit on")
        terms = index.postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(max_features)
        if isinstance(n_documents, int):
            n = F.lit(n_documents)
        else:
            counted = (n_documents if n_documents is not None else index.doc_info).agg(F.count("*").alias("n"))
            terms, n = terms.crossJoin(F.broadcast(counted)), F.col("n")  # one row
        # max_features rows, written once: documents and queries are weighted by them.
        vocabulary = settled(terms.select("term", "cf", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
        return cls(vocabulary, cls._weighted(index.postings, vocabulary, "doc_id"), normalizer=index.normalizer)

    @staticmethod
    def _weighted(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
        """tf x idf of terms in the vocabulary, each vector scaled to length 1; a vector of none has no rows."""
        raw = counts.join(vocabulary.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
        return raw.select(key, "term", (F.col("w") / norm).alias("w"))

    def embed(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, w) of a table (query_id, tokens)."""
        counts = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
        return self._weighted(counts, self.vocabulary, "query_id")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score): the documents of largest cosine; those that share no term aren't hits."""
        asked = settled(self.embed(queries).withColumnRenamed("w", "q"), "asked")  # of known size, so that it moves and the vectors don't
        pairs = self.vectors.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("q")), DIGITS).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def save(self, path: str) -> None:
        """As a new generation of the path."""
        folder = generations.begin(path)
        self.vocabulary.write.parquet(f"{folder}/vocabulary")
        self.vectors.write.parquet(f"{folder}/vectors")
        generations.publish(self.vocabulary.sparkSession, path, folder, normalizer=self.normalizer)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfIdf:
        """The latest generation; raises FileNotFoundError where there is none."""
        found = generations.current(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{found.folder}/{name}")
        return cls(read("vocabulary", "term string, cf long, df long, idf double"), read("vectors", "doc_id string, term string, w double"), normalizer=found.properties["normalizer"])


@dataclass(frozen=True)
class TextCollection:
    """Texts by their vectors: vectors(doc_id, term, w), metadata(doc_id, ...), and the model that embeds texts, if there is one."""

    vectors: DataFrame
    metadata: DataFrame
    model: TfIdf | None = None

    @classmethod
    def setup(cls, model: TfIdf, metadata: DataFrame) -> TextCollection:
        """The documents that the model was fitted on, with their metadata."""
        return cls(model.vectors, metadata, model)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextCollection:
        """The latest generation of the path, or an empty collection without a model."""
        found = generations.current(spark, path)
        if found is None:
            return cls(spark.createDataFrame([], "doc_id string, term string, w double"), spark.createDataFrame([], "doc_id string"))
        model = TfIdf.load(spark, f"{found.folder}/model") if found.properties["model"] == "True" else None
        vectors = spark.read.schema("doc_id string, term string, w double").parquet(f"{found.folder}/all")
        return cls(vectors, spark.read.parquet(f"{found.folder}/metadata"), model)

    def save(self, path: str) -> None:
        """As a new generation of the path, which may be the one it was opened from."""
        folder = generations.begin(path)
        self.vectors.write.parquet(f"{folder}/all")
        self.metadata.write.parquet(f"{folder}/metadata")
        if self.model:
            self.model.save(f"{folder}/model")
        generations.publish(self.vectors.sparkSession, path, folder, model=self.model is not None)

    def _embedder(self) -> TfIdf:
        if self.model is None:
            raise RuntimeError("texts need a model to embed them")
        return self.model

    def add(self, docs: DataFrame) -> TextCollection:
        """Canonical documents embedded by the model; they win by doc_id, of several for one the last by title and content.

        The metadata are the documents' scalar columns but id and content.
        """
        model = self._embedder()
        new = latest(docs.withColumn("doc_id", document_id(F.col("id"), F.col("url"))), "doc_id", [F.col("title"), F.col("content")])
        tokens = new.select(F.col("doc_id").alias("query_id"), normalizer_of(model.normalizer)(document_text(F.col("title"), F.col("content"))).alias("tokens"))
        ids = new.select("doc_id")
        kept = lambda rows: rows.join(ids, "doc_id", "left_anti").select(*rows.columns)
        vectors = kept(self.vectors).unionByName(model.embed(tokens).withColumnRenamed("query_id", "doc_id"))
        shown = new.select("doc_id", *(c for c in scalar_columns(new) if c != "doc_id"))
        return replace(self, vectors=vectors, metadata=kept(self.metadata).unionByName(shown, allowMissingColumns=True))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score, metadata...) of a table (query_id, query) of strings; texts that share no term aren't hits."""
        model = self._embedder()
        asked = queries.select("query_id", normalizer_of(model.normalizer)(F.col("query")).alias("tokens"))
        return replace(model, vectors=self.vectors).search(asked, k).join(self.metadata, "doc_id")

    def stats(self) -> DataFrame:
        return self.metadata.agg(F.count("*").alias("documents"))
