"""Tables of dense vectors: upsert, exact cosine search, counts."""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..session import fresh_dir, ship
from .index import latest

DIGITS = 6
#: Queries in a block, and blocks that meet the table in one pass.
QUERY_BLOCK, PASS = 2000, 20


def scalar_columns(df: DataFrame, drop: tuple[str, ...] = ("id", "content")) -> list[str]:
    """Metadata columns: strings, numbers and booleans but for id and content."""
    return [f.name for f in df.schema if f.name not in drop and isinstance(f.dataType, StringType | NumericType | BooleanType)]


@dataclass(frozen=True)
class VectorTable:
    """rows: doc_id, embedding array<float>, and any metadata columns."""

    rows: DataFrame

    @classmethod
    def setup(cls, vectors: DataFrame, metadata: DataFrame | None = None, check: bool = True) -> VectorTable:
        """Vectors (doc_id, embedding) with metadata by doc_id; raises ValueError if one of them has no other half."""
        if metadata is None:
            return cls(vectors)
        if check and not (vectors.join(metadata, "doc_id", "left_anti").isEmpty() and metadata.join(vectors, "doc_id", "left_anti").isEmpty()):
            raise ValueError("vectors and metadata have different doc_ids")
        return cls(vectors.join(metadata, "doc_id"))

    def upsert(self, new: DataFrame) -> VectorTable:
        """New rows win by doc_id; of several new ones for a doc_id the last by embedding."""
        fresh = latest(new, "doc_id", [F.col("embedding")])
        kept = self.rows.join(fresh.select("doc_id"), "doc_id", "left_anti").select(*self.rows.columns)
        return replace(self, rows=kept.unionByName(fresh, allowMissingColumns=True))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) by exact cosine, 1 - distance, to six decimals.

        Executors write the queries to the shared folder in blocks; the driver
        holds a path a block.  The table isn't moved: a task meets its rows with
        up to ``PASS`` blocks and returns the k best of each query, so what it
        holds, sends and shuffles is bounded.  Vectors and queries that are null
        or have a null or non-finite component take no part, nor does a vector
        of another length than the query's; a zero vector's cosine is 0.
        """
        spark = self.rows.sparkSession
        ship(spark)
        kinds = (queries.schema["query_id"].dataType, self.rows.schema["doc_id"].dataType)
        schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
        arrow = tuple(to_arrow_type(k) for k in kinds)
        rows = _usable(self.rows.select("doc_id", F.col("embedding").cast("array<double>").alias("v")))
        asked = _usable(queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")))
        blocks = fresh_dir(spark, "queries")
        asked.mapInArrow(_written(blocks), "path string, width int").write.parquet(f"{blocks}-paths")
        paths = sorted(r.path for r in spark.read.schema("path string, width int").parquet(f"{blocks}-paths").collect())  # a row a block
        out = spark.createDataFrame([], schema)
        for first in range(0, len(paths), PASS):
            out = out.union(rows.mapInArrow(_best(paths[first : first + PASS], k, arrow), schema))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def hits(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The search's hits with rank, score and the metadata a result shows; a missing url is the doc_id."""
        found = self.search(queries, k).join(self.rows.drop("embedding"), "doc_id")
        shown = [c for c in ("title", "url", "source", "date", "tags", "category") if c in found.columns]
        return found.select("query_id", "rank", "doc_id", "score", *(F.coalesce("url", F.col("doc_id").cast("string")).alias("url") if c == "url" else F.col(c) for c in shown))

    def stats(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("vectors"))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        return cls(spark.read.parquet(path))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` has a component, and none that is null or non-finite."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)


def _by_width(batch: pa.RecordBatch):
    """(ids, unit vectors) of a batch's rows of each length."""
    width = batch.column(1).value_lengths().to_numpy()
    for n in np.unique(width).tolist():
        some = batch.filter(pa.array(width == n))
        v = some.column(1).flatten().to_numpy().reshape(-1, n)
        yield some.column(0).to_pylist(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _written(folder: str):
    """Writes queries in blocks of one length."""

    def run(batches):
        held: dict[int, tuple[list, list[np.ndarray]]] = {}

        def flush(n: int) -> pa.RecordBatch:
            ids, parts = held.pop(n)
            path = f"{folder}/{uuid.uuid4().hex}"
            system, base = fs.FileSystem.from_uri(path)
            system.create_dir(base.rpartition("/")[0], recursive=True)
            with system.open_output_stream(base) as out:
                out.write(pickle.dumps((ids, np.concatenate(parts))))
            return pa.RecordBatch.from_pydict({"path": [path], "width": pa.array([n], pa.int32())})

        for batch in batches:
            for ids, v in _by_width(batch):
                for first in range(0, len(ids), QUERY_BLOCK):
                    own = held.setdefault(v.shape[1], ([], []))
                    own[0].extend(ids[first : first + QUERY_BLOCK])
                    own[1].append(v[first : first + QUERY_BLOCK])
                    if len(own[0]) >= QUERY_BLOCK:
                        yield flush(v.shape[1])
        for n in list(held):
            yield flush(n)

    return run


def _nominated(matrix: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query, ties to the first row, sorted by query, score and row.

    A matrix product nominates; the few rows that can be among the best once
    scores are rounded are scored again, adding up in one order for any batch, so
    that equal vectors have equal scores.
    """
    rough = matrix @ v.T
    if v.shape[0] > k:
        rough_kth = np.partition(rough, v.shape[0] - k, axis=1)[:, v.shape[0] - k]
        q, r = np.nonzero(rough >= rough_kth[:, None] - 3 * 10.0**-DIGITS)
    else:
        q, r = (x.ravel() for x in np.indices(rough.shape))
    score = np.empty(len(q))
    for first in range(0, len(q), 50_000):
        some = slice(first, first + 50_000)
        score[some] = np.einsum("pd,pd->p", matrix[q[some]], v[r[some]])
    score = np.round(score, DIGITS) + 0.0
    order = np.lexsort((r, -score, q))
    q, r, score = q[order], r[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], r[top], score[top]


def _best(paths: list[str], k: int, kinds: tuple[pa.DataType, pa.DataType]):
    """The k best of a task's rows for every query of some blocks."""

    def run(batches):
        blocks, best = [], []
        for path in paths:
            system, base = fs.FileSystem.from_uri(path)
            with system.open_input_file(base) as file:
                blocks.append(pickle.loads(file.read()))
            best.append((np.zeros(0, int), np.zeros(0), np.zeros(0, object)))
        for batch in batches:
            for docs, v in _by_width(batch):
                docs = np.array(docs, object)
                order = np.argsort(docs, kind="stable")
                docs, v = docs[order], v[order]
                for b, (_, matrix) in enumerate(blocks):
                    if matrix.shape[1] != v.shape[1]:
                        continue
                    found, rows, scores = _nominated(matrix, v, k)
                    q, score, ids = (np.concatenate(pair) for pair in zip(best[b], (found, scores, docs[rows]), strict=True))
                    place = np.empty(len(ids), int)
                    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                    at = np.lexsort((place, -score, q))
                    q, score, ids = q[at], score[at], ids[at]
                    top = np.arange(len(q)) - np.searchsorted(q, q) < k
                    best[b] = q[top], score[top], ids[top]
        for (asked, _), (q, score, ids) in zip(blocks, best, strict=True):
            if len(q):
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([asked[i] for i in q.tolist()], kinds[0]),
                    "doc_id": pa.array(ids.tolist(), kinds[1]),
                    "score": pa.array(score, pa.float64()),
                })

    return run
