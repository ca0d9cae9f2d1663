"""Query likelihood with Dirichlet smoothing, and relevance-model feedback.

Everything works on a table of queries (query_id, term, weight): one
interactive query is a table of one query.  Score of a document d for a query:

    sum_t w_t ln((tf + mu p_t) / (len_d + mu))
      = sum over matched t of w_t ln(1 + tf / (mu p_t)) + sum_t w_t ln(mu p_t) - W ln(len_d + mu)

so only matched postings are joined, never candidates with all terms.  Scores
equal to six decimals are ties, which go to the lesser doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import brief_shuffles, in_buckets, joins_in_place, settled
from ..sources import generations
from .index import Index
from .stored import RANGES, StoredIndex, folder_of

#: Smoothing, probability of a term the collection lacks, feedback documents, terms and mixing weight.
MU, UNSEEN, FEEDBACK_DOCS, FEEDBACK_TERMS, ALPHA = 2000.0, 1e-9, 5, 10, 0.5
DIGITS = 6
#: Postings that a task adds up by query and document.
TASK_MATCHES = 500_000


@dataclass(frozen=True)
class LanguageModel:
    index: Index | None = None
    collection: DataFrame | None = None
    mu: float = MU

    @classmethod
    def fit(cls, index: Index, mu: float = MU) -> LanguageModel:
        if mu <= 0:
            raise ValueError("mu must be positive")
        return cls(index, index.collection(), mu)

    def save(self, path: str) -> None:
        """As a new generation of the path: the index laid out for queries, and the terms' probabilities in the same folders."""
        spark, folder = self.collection.sparkSession, generations.begin(path)
        self.index.save(f"{folder}/index")
        folders = StoredIndex.open(spark, f"{folder}/index").term_folders
        terms = self.collection.withColumn("folder", folder_of(F.col("term"), folders)).repartition("folder")
        with brief_shuffles(spark):
            terms.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{folder}/collection")
        generations.publish(spark, path, folder, mu=self.mu)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        """The latest generation; raises FileNotFoundError where no model was saved."""
        found = generations.current(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        index = StoredIndex.open(spark, f"{found.folder}/index")
        table = spark.read.schema("term string, cf long, df long, p double, folder int").parquet(f"{found.folder}/collection")
        return StoredModel(index, table.drop("folder"), float(found.properties["mu"]), table)

    def stats(self) -> DataFrame:
        return self.index.stats()

    def _probabilities(self, queries: DataFrame) -> DataFrame:
        """The queries' terms with p; raises RuntimeError without a model to ask."""
        if self.collection is None:
            raise RuntimeError("no model: fit one to an index, or load one")
        known = self._known(queries.select("term").distinct())
        # A row a query and term: written once, so that what they come from (a first retrieval, in feedback) isn't computed
        # again where they are used, and Spark, which knows their size, moves them to the postings.
        return settled(queries.join(known, "term", "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN))), "asked")

    def _known(self, asked: DataFrame) -> DataFrame:
        """(term, p) of those of some distinct terms that the collection has."""
        return self.collection.select("term", "p").join(settled(asked, "asked"), "term")

    def _constants(self, terms: DataFrame) -> DataFrame:
        """(query_id, base, all): what every score of a query has, and the sum of its weights."""
        return terms.groupBy("query_id").agg(F.sum(F.col("weight") * F.log(self.mu * F.col("p"))).alias("base"), F.sum("weight").alias("all"))

    def scores(self, queries: DataFrame, category: str | None = None) -> DataFrame:
        """(query_id, doc_id, score) of every document with at least one term of the query."""
        mu, terms = F.lit(self.mu), self._probabilities(queries)
        info = self.index.doc_info.select("doc_id", "length", "category")
        matched = self.index.postings.join(terms, "term")
        if category:
            info = info.where(F.col("category") == category)
            matched = matched.join(info.select("doc_id"), "doc_id", "left_semi")  # before anything is summed
        summed = matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.log(1 + F.col("tf") / (mu * F.col("p")))).alias("match"))
        return (
            summed.join(info, "doc_id")
            .join(self._constants(terms), "query_id")
            .select("query_id", "doc_id", (F.col("match") + F.col("base") - F.col("all") * F.log(F.col("length") + mu)).alias("score"))
        )

    def naive_scores(self, queries: DataFrame) -> DataFrame:
        """The same scores term by term over all candidates; for tests of the short form."""
        terms = queries.join(self.collection.select("term", "p"), "term", "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN)))
        candidates = self.index.postings.join(terms.select("query_id", "term"), "term").select("query_id", "doc_id").distinct()
        rows = candidates.join(terms, "query_id").join(self.index.postings, ["doc_id", "term"], "left").join(self.index.doc_info.select("doc_id", "length"), "doc_id")
        one = F.col("weight") * F.log((F.coalesce("tf", F.lit(0)) + self.mu * F.col("p")) / (F.col("length") + self.mu))
        return rows.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"))

    def retrieve(self, queries: DataFrame, k: int = 10, category: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): each query's k best documents, of those that ``keep`` leaves of (query_id, doc_id, score)."""
        return _first(self.scores(queries, category), k, keep)

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """Hits with their documents' info."""
        return self.index.info_of(hits)

    def relevance_model(self, queries: DataFrame, k: int = FEEDBACK_DOCS) -> DataFrame:
        """(query_id, term, weight): the k best documents' terms, weighted by the documents' posteriors."""
        hits = self.retrieve(queries, k)
        whole = Window.partitionBy("query_id")
        odds = hits.withColumn("odds", F.exp(F.col("score") - F.max("score").over(whole)))
        posterior = odds.select("query_id", "doc_id", "rank", (F.col("odds") / F.sum("odds").over(whole)).alias("weight"))
        docs = settled(self.index.info_of(posterior).select("query_id", "doc_id", "length", "weight"), "asked")  # k rows a query
        mass = self.index.terms_of(docs).groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("length") * F.col("weight")).alias("mass"))
        return mass.select("query_id", "term", (F.col("mass") / F.sum("mass").over(whole)).alias("weight"))

    def expand(self, queries: DataFrame, k: int = FEEDBACK_DOCS, terms: int = FEEDBACK_TERMS, alpha: float = ALPHA) -> DataFrame:
        """(query_id, term, weight): the mixture of query and relevance model, its best terms, summing to 1.

        A query without a hit keeps its weights.
        """
        model = self.relevance_model(queries, k)
        both = queries.select("query_id", "term", F.col("weight").alias("own")).join(model.select("query_id", "term", F.col("weight").alias("fed")), ["query_id", "term"], "full_outer")
        whole = Window.partitionBy("query_id")
        fed = F.max(F.col("fed").isNotNull()).over(whole)
        own, other = F.coalesce("own", F.lit(0.0)), F.coalesce("fed", F.lit(0.0))
        mixed = both.select("query_id", "term", fed.alias("fed"), F.when(fed, alpha * own + (1 - alpha) * other).otherwise(own).alias("weight"))
        place = F.row_number().over(whole.orderBy(F.desc(F.round("weight", 12)), "term"))
        best = mixed.withColumn("place", place).where(~F.col("fed") | (F.col("place") <= terms))
        total = F.sum("weight").over(whole)
        scaled = F.when(F.col("fed") & (total > 0), F.col("weight") / total).otherwise(F.col("weight"))
        return best.select("query_id", "term", scaled.alias("weight"))


def _first(scores: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's k best."""
    scores = scores.withColumn("score", F.round("score", DIGITS))
    if keep:
        scores = keep(scores)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


@dataclass(frozen=True)
class StoredModel(LanguageModel):
    """A loaded model: reads its queries' terms and its hits' documents alone, and can do without scoring every match."""

    table: DataFrame | None = None

    def _known(self, asked: DataFrame) -> DataFrame:
        some = self.index.with_folder(settled(asked, "asked"), "term", self.index.term_folders)
        return self.table.join(some.where("term <> ''"), ["folder", "term"]).select("term", "p", "df")

    def _parts(self, terms: DataFrame) -> int:
        """Into how many parts the blocks of a query table's terms are dealt out, by range: as many as make ``TASK_MATCHES`` matches each.

        A part's sums are held at once.  There is no use in many more parts than ranges.
        """
        matches = terms.where("weight > 0").agg(F.sum("df")).first()[0] or 0
        return min(max(-(-matches // TASK_MATCHES), terms.sparkSession.sparkContext.defaultParallelism), 4 * RANGES)

    def scores(self, queries: DataFrame, category: str | None = None) -> DataFrame:
        terms = self._probabilities(queries)
        return self._finished(self._added(self.index.blocks_of(terms, self._parts(terms)).join(self._constants(terms), "query_id"), category))

    def _blocks(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The queries' terms' posting blocks, each once, in buckets of ranges; for each query, their counts and bounds; and the number of buckets.

        ``most`` is what a posting of the block adds to a score at most; constants of the query are with it.
        """
        terms = self._probabilities(queries)
        parts = self._parts(terms)
        blocks = in_buckets(self.index.distinct_blocks(terms.where("weight > 0")).repartition(parts, "range"), "blocks", "range", parts)
        asked = settled(terms.where("weight > 0").join(self._constants(terms), "query_id"), "asked")
        bounds = blocks.select("term", "range", "n", "max_tf", "min_length").join(asked, "term")
        return blocks.select("term", "range", "postings"), bounds.withColumn("most", F.col("weight") * F.log(1 + F.col("max_tf") / (self.mu * F.col("p")))), parts

    def _seeded(self, blocks: DataFrame, seeds: int) -> DataFrame:
        """(query_id, range) of the ranges of greatest bound."""
        free = F.min("base") - F.min("all") * F.log(F.min("min_length") + self.mu)
        bounds = blocks.groupBy("query_id", "range").agg((F.sum("most") + free).alias("bound"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        return bounds.withColumn("place", place).where(F.col("place") <= seeds).select("query_id", "range")

    def _added(self, blocks: DataFrame, category: str | None) -> DataFrame:
        """(query_id, doc_id, match, base, all, length, ...) of posting blocks, summed by document; further columns are the range's."""
        others = [c for c in blocks.columns if c in ("threshold", "rest")]
        rows = blocks.select("query_id", "range", "weight", "p", "base", "all", *others, F.inline("postings"))
        if category:
            rows = rows.where(F.col("category") == category)
        # A document is in one range, by which the blocks are dealt out: no shuffle.
        return rows.groupBy("query_id", "range", "doc_id").agg(F.sum(self._one()).alias("match"), *(F.first(c).alias(c) for c in ("base", "all", "length", *others)))

    def _one(self) -> Column:
        """What a posting adds to its document's score."""
        return F.col("weight") * F.log(1 + F.col("tf") / (self.mu * F.col("p")))

    def _score(self) -> Column:
        return F.col("match") + F.col("base") - F.col("all") * F.log(F.col("length") + self.mu)

    def _finished(self, added: DataFrame) -> DataFrame:
        return added.select("query_id", "doc_id", self._score().alias("score"))

    def pruned(self, queries: DataFrame, k: int = 10, category: str | None = None, seeds: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
        """The same rows as ``retrieve``, and the blocks and postings that had to be scored for them.

        1. The k (or ``seeds``) ranges of greatest bound are scored; their k-th best score is a
           query's threshold (a query of fewer matches there has none).
        2. In every range the blocks that add least are put aside, as many as
           together can't lift a document over the threshold: mostly frequent
           terms, whose postings are the most.  A document without any other term
           is out; a range without any other block is passed over whole.
        3. What is left is scored; documents that can still reach the threshold
           with all that was put aside get that too.

        All of it lies in buckets of ranges, where it is joined and summed; the result is written.
        """
        with joins_in_place(queries.sparkSession):
            return self._pruned(queries, k, category, seeds)

    def _pruned(self, queries: DataFrame, k: int, category: str | None, seeds: int | None) -> tuple[DataFrame, dict[str, DataFrame]]:
        blocks, bounds, parts = self._blocks(queries)
        whole_block = lambda some: some.join(blocks, ["range", "term"])
        ranges = settled(self._seeded(bounds, seeds or k), "seeds")
        seeded = bounds.join(ranges, ["query_id", "range"])
        known = self._finished(self._added(whole_block(seeded), category))
        threshold = settled(_first(known, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold")), "threshold")
        others = bounds.join(ranges, ["query_id", "range"], "left_anti")
        whole = Window.partitionBy("query_id", "range")
        least_first = whole.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        free = F.col("base") - F.col("all") * F.log(F.min("min_length").over(whole) + self.mu)
        enough = F.col("threshold") - 10.0**-DIGITS
        ranked = others.join(threshold, "query_id", "left").withColumn("sum", F.sum("most").over(least_first))
        ranked = ranked.withColumn("counts", F.col("threshold").isNull() | (F.col("sum") + free >= enough))
        ranked = ranked.withColumn("rest", F.coalesce(F.max(F.when(~F.col("counts"), F.col("sum"))).over(whole), F.lit(0.0)))
        first = self._added(whole_block(ranked.where("counts")), category)
        alive = in_buckets(first.where(F.col("threshold").isNull() | (self._score() + F.col("rest") >= enough)), "alive", "range", parts)
        open_ranges = alive.where("rest > 0").select("query_id", "range").distinct()
        aside = whole_block(ranked.where(~F.col("counts")).join(open_ranges, ["query_id", "range"])).select("query_id", "range", "weight", "p", F.inline("postings"))
        late = aside.join(alive.select("query_id", "range", "doc_id"), ["query_id", "range", "doc_id"])
        added = late.groupBy("query_id", "range", "doc_id").agg(F.sum(self._one()).alias("late"))
        done = alive.join(added, ["query_id", "range", "doc_id"], "left").withColumn("match", F.col("match") + F.coalesce("late", F.lit(0.0)))
        found = settled(_first(self._finished(done), k), "found").unionByName(settled(_first(known, k), "found"))  # k rows a query each
        return _first(found, k), {"seeds": seeded, "blocks": ranked.where("counts"), "late": late}

    def scored(self, queries: DataFrame, k: int = 10, seeds: int | None = None) -> DataFrame:
        """(query_id, scored, matching): how many postings ``pruned`` scores, and how many match."""
        work = self.pruned(queries, k, seeds=seeds)[1]
        parts = [work["seeds"].select("query_id", "n"), work["blocks"].select("query_id", "n"), work["late"].select("query_id", F.lit(1).cast("long").alias("n"))]
        scored = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id").agg(F.sum("n").alias("scored"))
        return scored.join(self._blocks(queries)[1].groupBy("query_id").agg(F.sum("n").alias("matching")), "query_id").select("query_id", "scored", "matching")
