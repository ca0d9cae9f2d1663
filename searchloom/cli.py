"""Command line: index a collection, build a model, query it.

    python -m searchloom.cli index DATA INDEX     JSON lines to an index
    python -m searchloom.cli build INDEX MODEL    index to a language model
    python -m searchloom.cli query MODEL          questions from standard input
    python -m searchloom.cli auto INDEX MODEL     query if the model is there, else build
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.index import Index, build_index
from .operators.language_model import LanguageModel
from .plans.search import search
from .sources import generations
from .sources.jsonl import DocumentStore


def index(spark: SparkSession, data: str, out: str) -> int:
    store = DocumentStore.load(spark, data)
    if store.documents.isEmpty():
        print("no documents", file=sys.stderr)
        return 1
    build_index(store.documents).save(out)
    print(Index.load(spark, out).stats().first())
    return 0


def build(spark: SparkSession, source: str, out: str) -> int:
    try:
        found = Index.load(spark, source)
    except FileNotFoundError:
        print("no index; run index first", file=sys.stderr)
        return 1
    if len(found.doc_info.take(2)) < 2:
        print("an index of at least two documents is needed", file=sys.stderr)
        return 1
    LanguageModel.fit(found).save(out)
    return 0


def query(spark: SparkSession, source: str, k: int = 5, lines=sys.stdin) -> int:
    try:
        model = LanguageModel.load(spark, source)
    except FileNotFoundError:
        print("no model; run build first", file=sys.stderr)
        return 0
    for line in lines:
        if line.strip().lower() in ("exit", "quit"):
            break
        if line.strip():
            for hit in search(model, spark.createDataFrame([(0, line)], "query_id long, query string"), k).orderBy("rank").collect():  # k rows
                print(f"{hit['rank']}. {hit.score:.4f} {hit.title or hit.doc_id} [{hit.source}] {(hit.date or '')[:10]} {hit.url or ''}")
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("index", "build", "query", "auto"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-k", type=int, default=5)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("searchloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        return index(spark, *a.paths)
    if a.command == "build":
        return build(spark, *a.paths)
    if a.command == "query":
        return query(spark, a.paths[0], a.k)
    return query(spark, a.paths[1], a.k) if generations.current(spark, a.paths[1]) else build(spark, *a.paths)


if __name__ == "__main__":
    sys.exit(main())
