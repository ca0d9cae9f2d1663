"""Query strings: cleaning, ``key:value`` filters, tokens and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import clean, normalizer as normalizer_of

#: Fixed pattern: a whole white-space token that is a filter.
FILTER = r"^[\p{L}\p{N}_]+:\S+$"


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) entries in which the last of equal keys counts, whatever the session's policy."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def process(queries: DataFrame, query: str = "query", normalize_query: bool = False, normalizer: str = "spanish") -> DataFrame:
    """Adds original, text, tokens, filters and expanded to a table of query strings.

    The tokens of the text are split at white space alone, as typed; with
    ``normalize_query`` they are normalised like documents, by the ``normalizer`` of that name.
    """
    cleaned = queries.withColumn("original", F.col(query)).withColumn("_all", F.filter(F.split(clean(F.coalesce(F.col(query), F.lit(""))), " "), lambda t: t != ""))
    pairs = F.transform(F.filter("_all", lambda t: t.rlike(FILTER)), lambda t: F.struct(F.substring_index(t, ":", 1).alias("key"), F.regexp_replace(t, r"^[^:]+:", "").alias("value")))
    words = F.filter("_all", lambda t: ~t.rlike(FILTER))
    out = cleaned.withColumn("text", F.array_join(words, " ")).withColumn("filters", _last_wins(pairs)).withColumn("tokens", normalizer_of(normalizer)(F.col("text")) if normalize_query else words)
    return out.withColumn("expanded", F.lit(False)).drop("_all")


def weights(processed: DataFrame, query_id: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """(query_id, term, weight): relative frequencies of each query's tokens; a query without tokens has none."""
    terms = processed.select(F.col(query_id).alias("query_id"), F.explode(tokens).alias("term"), F.size(tokens).alias("n"))
    return terms.groupBy("query_id", "term").agg((F.count("*") / F.first("n")).alias("weight"))
