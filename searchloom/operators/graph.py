"""Approximate cosine search: a navigable graph a shard, beam search, and upserts that touch their shards alone.

Vectors are dealt to shards by a hash of their id.  A shard's task links every
vector to its nearest ones and to a few chosen at random, both ways, and writes
one row: ids, unit vectors and links.  A search meets every shard with blocks of
queries; from a few entry points a beam goes on to the neighbours of the best node
not yet expanded, for all queries of a block at once, until the beam holds no
better one.  The k best of every shard are merged.

An upsert reads, changes and writes the shards of its ids only, as a new
generation; a shard's last generation counts.  Shards that grow to twice their
size call for a new ``build``.

Scores, ties and rows that take no part are as in the exact search (``vectors``);
what the graph doesn't reach isn't found.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import fresh_dir, ship
from ..sources import generations
from .index import latest
from .vectors import DIGITS, _usable, _written

#: Vectors of a shard, links to nearest and to random ones, nodes of the beam, entry points, and queries searched at once.
SHARD, NEAREST, RANDOM, BEAM, ENTRIES, AT_ONCE = 8192, 24, 8, 96, 16, 256
_SHARD = "shard int, width int, n int, ids binary, vectors binary, links binary"


def _nearest(own: np.ndarray, every: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    """Places of the k vectors of greatest cosine for each of some, without itself, in slices."""
    out = []
    for first in range(0, len(own), 512):
        score = own[first : first + 512] @ every.T
        score[np.arange(len(score)), skip[first : first + 512]] = -np.inf
        out.append(np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.argsort(-score, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), int)


def _linked(vectors: np.ndarray, links: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The links with those of the places ``fresh``: to nearest and random nodes, and back from them; -1 is none."""
    n, degree = len(vectors), NEAREST + RANDOM
    rng = np.random.default_rng(n)
    near = _nearest(vectors[fresh], vectors, min(NEAREST, n - 1), fresh) if n > 1 else np.zeros((len(fresh), 0), int)
    links = np.concatenate([links, np.full((n - len(links), 2 * degree), -1, np.int32)])
    links[fresh, : near.shape[1]] = near
    links[fresh, NEAREST:degree] = rng.integers(0, n, (len(fresh), RANDOM))
    # Back links: each node takes the first that come, up to as many as it has of its own.
    to, back = links[fresh, :degree].ravel(), np.repeat(fresh, degree)
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    used = (links[:, degree:] >= 0).sum(axis=1)
    place = np.arange(len(to)) - np.searchsorted(to, to) + used[to]
    fits = place < degree
    links[to[fits], degree + place[fits]] = back[fits]
    return links


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the beam's best for each query; -1 where there is none."""
    q, n = len(queries), len(vectors)
    entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))
    node = np.full((q, beam), -1, np.int64)
    score, open_ = np.full((q, beam), -np.inf), np.zeros((q, beam), bool)
    m = min(len(entries), beam)
    node[:, :m], score[:, :m], open_[:, :m] = entries[:m], queries @ vectors[entries[:m]].T, True
    seen = np.zeros((q, n), bool)
    seen[:, entries[:m]] = True
    active = np.arange(q)
    while len(active):
        best = np.where(open_[active], score[active], -np.inf)
        at = best.argmax(axis=1)
        going = open_[active, at]
        active, at = active[going], at[going]
        if not len(active):
            break
        open_[active, at] = False
        to = links[node[active, at]]
        fine = to >= 0
        rows = np.broadcast_to(active[:, None], to.shape)
        fine &= ~seen[rows, np.where(fine, to, 0)]
        # A node that is linked twice counts once.
        order = np.sort(np.where(fine, to, -1), axis=1)
        twice = np.concatenate([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]], axis=1)
        to, fine = order, (order >= 0) & ~twice
        found = np.where(fine, np.einsum("qjd,qd->qj", vectors[np.where(fine, to, 0)], queries[active]), -np.inf)
        seen[rows[fine], to[fine]] = True
        both = np.concatenate([score[active], found], axis=1)
        nodes = np.concatenate([node[active], np.where(fine, to, -1)], axis=1)
        opens = np.concatenate([open_[active], fine], axis=1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        score[active], node[active], open_[active] = (np.take_along_axis(x, top, axis=1) for x in (both, nodes, opens))
    top = np.argsort(-score, axis=1, kind="stable")[:, : min(max(2 * k, k + 8), beam)]
    return np.take_along_axis(node, top, axis=1), np.take_along_axis(score, top, axis=1)


def _shard(number: int, ids: list, vectors: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    row = [number], [vectors.shape[1]], [len(ids)], [pickle.dumps(ids)], [vectors.tobytes()], [links.astype(np.int32).tobytes()]
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])


def _loaded(batch: pa.RecordBatch, i: int, at: int = 0) -> tuple[int, list, np.ndarray, np.ndarray]:
    shard, width, n, ids, vectors, links = (batch.column(at + c)[i].as_py() for c in range(6))
    return shard, pickle.loads(ids), np.frombuffer(vectors, np.float32).reshape(n, width), np.frombuffer(links, np.int32).reshape(n, -1)


def _built(batches):
    """(shard, width, doc_id, v) sorted by shard and width, to a row a shard and width."""

    def close(key, rows):
        table = pa.Table.from_batches(rows)
        v = np.concatenate([c.flatten().to_numpy() for c in table.column(3).chunks]).reshape(-1, key[1])
        v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)
        none = np.zeros((0, 2 * (NEAREST + RANDOM)), np.int32)
        return _shard(key[0], table.column(2).to_pylist(), v, _linked(v, none, np.arange(len(v))))

    held, key = [], None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if key is not None and keys[first] != key:
                    yield close(key, held)
                    held = []
                key = keys[first]
                held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield close(key, held)


def _searched(paths: list[str], k: int, beam: int, kinds):
    """Shards (rows of _SHARD) to (query_id, doc_id, score) of the best of every query of some blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, vectors, links = _loaded(batch, i)
                for path in paths:
                    system, base = fs.FileSystem.from_uri(path)
                    with system.open_input_file(base) as file:
                        asked, matrix = pickle.loads(file.read())
                    if matrix.shape[1] != vectors.shape[1]:
                        continue
                    for first in range(0, len(asked), AT_ONCE):
                        own = matrix[first : first + AT_ONCE]
                        node, _ = _beam(vectors, links, own.astype(np.float32), k, max(beam, k))
                        exact = np.einsum("qjd,qd->qj", vectors[np.maximum(node, 0)].astype(np.float64), own)
                        q, j = np.nonzero(node >= 0)
                        yield pa.RecordBatch.from_pydict({
                            "query_id": pa.array([asked[first + x] for x in q.tolist()], kinds[0]),
                            "doc_id": pa.array([ids[x] for x in node[q, j].tolist()], kinds[1]),
                            "score": pa.array(np.round(exact[q, j], DIGITS) + 0.0),
                        })

    return run


def _changed(batches):
    """A shard's row beside its new vectors (doc_ids, vs): the shard with these inserted, or in the place of their old ones."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, ids, vectors, links = _loaded(batch, i)
            new, v = batch.column(6)[i].as_py(), np.array(batch.column(7)[i].as_py(), np.float64).reshape(-1, vectors.shape[1])
            v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)
            gone = set(new)
            keep = np.array([x not in gone for x in ids], bool)
            place = np.append(np.where(keep, np.cumsum(keep) - 1, -1), -1)
            kept = place[links[keep]].astype(np.int32)  # links to what went are none
            every = np.concatenate([vectors[keep], v])
            yield _shard(shard, [x for x, k in zip(ids, keep.tolist(), strict=True) if k] + new, every, _linked(every, kept, np.arange(len(kept), len(every))))


@dataclass(frozen=True)
class GraphIndex:
    """``shards``: a row of _SHARD for each shard and vector length, of its last generation."""

    spark: SparkSession
    path: str
    shards: DataFrame
    count: int
    kind: str
    folders: tuple[str, ...]

    @classmethod
    def build(cls, rows: DataFrame, path: str, shard: int = SHARD) -> GraphIndex:
        """A new index at the path, of rows (doc_id, embedding) of unique ids."""
        spark = rows.sparkSession
        ship(spark)
        usable = _usable(rows.select("doc_id", F.col("embedding").cast("array<double>").alias("v")))
        count = max(-(-usable.count() // shard), 1)
        dealt = usable.select(F.pmod(F.hash("doc_id"), F.lit(count)).alias("shard"), F.size("v").alias("width"), "doc_id", "v")
        folder = generations.begin(path)
        dealt.repartition(count, "shard").sortWithinPartitions("shard", "width").mapInArrow(_built, _SHARD).write.parquet(folder)
        kind = rows.schema["doc_id"].dataType.simpleString()
        generations.publish(spark, path, folder, count=count, kind=kind, folders=folder)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphIndex:
        """Raises FileNotFoundError where none was built."""
        found = generations.current(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        ship(spark)
        folders = tuple(found.properties["folders"].split("\n"))
        # A shard's last generation counts; a row a shard travels, its data don't.
        every = None
        for i, folder in enumerate(folders):
            own = spark.read.schema(_SHARD).parquet(folder).withColumn("generation", F.lit(i))
            every = own if every is None else every.unionByName(own)
        if len(folders) > 1:
            last = every.groupBy("shard", "width").agg(F.max("generation").alias("generation"))
            every = every.join(F.broadcast(last), ["shard", "width", "generation"], "left_semi")  # a row a shard
        return cls(spark, path, every.drop("generation"), int(found.properties["count"]), found.properties["kind"], folders)

    def search(self, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
        """(query_id, rank, doc_id, score) of a table (query_id, embedding); a wider ``beam`` finds more."""
        kinds = queries.schema["query_id"].dataType, self.spark.createDataFrame([], f"d {self.kind}").schema["d"].dataType
        blocks = fresh_dir(self.spark, "queries")
        asked = _usable(queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")))
        asked.mapInArrow(_written(blocks), "path string, width int").write.parquet(f"{blocks}-paths")
        paths = sorted(r.path for r in self.spark.read.schema("path string, width int").parquet(f"{blocks}-paths").collect())  # a row a block
        schema = f"query_id {kinds[0].simpleString()}, doc_id {self.kind}, score double"
        found = self.shards.mapInArrow(_searched(paths, k, beam, tuple(to_arrow_type(t) for t in kinds)), schema)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def upsert(self, new: DataFrame) -> GraphIndex:
        """New rows (doc_id, embedding) win by doc_id among those of their length, of several for one the last by embedding."""
        fresh = _usable(latest(new, "doc_id", [F.col("embedding")]).select("doc_id", F.col("embedding").cast("array<double>").alias("v")))
        dealt = fresh.select(F.pmod(F.hash("doc_id"), F.lit(self.count)).alias("shard"), F.size("v").alias("width"), "doc_id", "v")
        each = dealt.groupBy("shard", "width").agg(F.collect_list("doc_id").alias("new_ids"), F.flatten(F.collect_list("v")).alias("new_vectors"))  # a shard's part
        names = [x.split()[0] for x in _SHARD.split(", ")]
        touched = self.shards.join(each, ["shard", "width"]).select(*names, "new_ids", "new_vectors")
        folder = generations.begin(self.path)
        lone = dealt.join(self.shards.select("shard", "width"), ["shard", "width"], "left_anti").select("shard", "width", "doc_id", "v")
        begun = lone.repartition(self.count, "shard").sortWithinPartitions("shard", "width").mapInArrow(_built, _SHARD)
        touched.mapInArrow(_changed, _SHARD).unionByName(begun).write.parquet(folder)
        generations.publish(self.spark, self.path, folder, count=self.count, kind=self.kind, folders="\n".join((*self.folders, folder)))
        return self.open(self.spark, self.path)

    def stats(self) -> DataFrame:
        return self.shards.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("vectors"))
