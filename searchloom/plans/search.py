"""The whole search: query strings to hydrated hits, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.queries import process, weights
from ..operators.language_model import ALPHA, FEEDBACK_DOCS, FEEDBACK_TERMS, LanguageModel


def search(
    model: LanguageModel,
    queries: DataFrame,
    k: int = 5,
    feedback: bool = True,
    category: str | None = None,
    apply_filters: bool = False,
    normalize_query: bool = False,
    prf_k: int = FEEDBACK_DOCS,
    prf_terms: int = FEEDBACK_TERMS,
    prf_alpha: float = ALPHA,
) -> DataFrame:
    """Hits of a table (query_id, query): parse, weigh, retrieve, expand, retrieve again, add the documents' info.

    ``apply_filters`` keeps hits whose ``source`` and ``category`` are those
    that the query's filters name; by default filters are only parsed.
    """
    parsed = process(queries, normalize_query=normalize_query, normalizer=model.index.normalizer)
    weighed = weights(parsed)
    if feedback:
        weighed = model.expand(weighed, prf_k, prf_terms, prf_alpha)

    def allowed(scores: DataFrame) -> DataFrame:
        """Candidates whose documents the query's filters name, before the best are chosen."""
        info = model.index.doc_info.select("doc_id", "source", "category")
        rows = scores.join(parsed.select("query_id", "filters"), "query_id").join(info, "doc_id")
        for name in ("source", "category"):
            rows = rows.where(F.coalesce(F.try_element_at("filters", F.lit(name)) == F.lower(F.col(name)), F.lit(True)))
        return rows.select(*scores.columns)

    return model.hydrate(model.retrieve(weighed, k, category, allowed if apply_filters else None))
