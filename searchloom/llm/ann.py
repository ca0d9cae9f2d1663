"""Approximate nearest neighbours by a few stable projections and kd-trees.

Vectors are extended by one coordinate so that the largest inner product becomes
the smallest Euclidean distance: all extended vectors have the norm of the
longest, and a query is scaled to that norm.  ``DIMENSIONS`` Gaussian (2-stable)
projections of an extended vector form its image.  If a vector lies at distance
d, its squared image distance over d squared is a chi-square variable of
``DIMENSIONS`` degrees of freedom.  So neighbours are verified on the original
vectors, in double precision, by growing image distance r, until the stopping
test holds: a vector as near as the k-th found has an image distance below r with
a chance of at least ``CONFIDENCE``.

Index.  A kd-tree over the images of a bounded sample (about ``SAMPLE`` vectors,
chosen by hash) splits the images' space into cells; every vector goes to its
cell's shard, and a cell with more vectors than two shards should hold, be they
equal, is dealt out to several.  Each shard gets a kd-tree of its own and is
written once; the driver holds a path and a bounding box a shard.

Search.  A query first meets the shard nearest to its image, which gives its k-th
distance.  It then meets only the shards whose boxes lie within the stopping
test's reach of that distance, and in them only the leaves and the points within
it.  A block of at most about ``QUERIES`` queries meets a shard in a task.

Defined cases: null and zero vectors and those with a null or non-finite
component take no part; vectors of different lengths have no product, so each
length is searched apart; a null id takes no part; a candidate with the query's
id is skipped, repeated ids are candidates each; equal rows among the queries are
one query; ties go to the smaller id; fewer than k candidates are all returned;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import forget
from .common import batched, fresh_dir, read_table, save
from .files import Reader, write_new
from .textbytes import mix

DIMENSIONS, CONFIDENCE, SHARD, QUERIES, LEAF, SEED, SAMPLE = 24, 0.8, 8_192, 2_000, 64, 7, 50_000


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for even degrees of freedom."""
    half = x / 2
    if half > 700:
        return 1.0
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


class KdTree:
    """Splits points at the median of their widest coordinate down to leaves of ``leaf`` points.

    Leaves are slices of ``order`` with bounding boxes; neighbours come leaf by
    leaf in order of the boxes' distance, which bounds all points still to come.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                bounds.append((lo, hi))
                continue
            own = self.order[lo:hi]
            axis = int(np.ptp(points[own], axis=0).argmax())
            mid = (hi - lo) // 2
            self.order[lo:hi] = own[np.argpartition(points[own, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        bounds.sort()
        self.bounds = np.array(bounds, np.int64).reshape(-1, 2)
        sorted_points = points[self.order]
        starts = self.bounds[:, 0]
        self.low = np.minimum.reduceat(sorted_points, starts) if len(starts) else points
        self.high = np.maximum.reduceat(sorted_points, starts) if len(starts) else points


@lru_cache(maxsize=8)
def reach(confidence: float = CONFIDENCE, degrees: int = DIMENSIONS) -> float:
    """The squared image distance, in squared distances, that a vector stays below with a chance of ``confidence``."""
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < confidence else (lo, mid)
    return hi


@lru_cache(maxsize=8)
def projection(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, dimensions))


def images(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The images of vectors, each extended to ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack((vectors, rest[:, None])) @ projection(vectors.shape[1])


def query_images(queries: np.ndarray, norm: float) -> np.ndarray:
    """The images of queries, each scaled to ``norm``."""
    scale = norm / np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return (queries * scale[:, None]) @ projection(queries.shape[1])[:-1]


def box_distances(low: np.ndarray, high: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Squared distances of an image from boxes."""
    gap = np.maximum(np.maximum(low - image, image - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class Shard:
    """A shard's vectors in the order of its tree's leaves, and their images."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.norm, tree = norm, KdTree(images(vectors, norm))
        self.ids, self.vectors, self.points = ids[tree.order], np.ascontiguousarray(vectors[tree.order]), np.ascontiguousarray(tree.points[tree.order])
        self.bounds, self.low, self.high = tree.bounds, tree.low, tree.high
        #: Vectors verified by all searches.
        self.verified = 0

    def dump(self) -> bytes:
        sizes = np.array([len(self.ids), self.vectors.shape[1], self.points.shape[1], len(self.bounds)], np.int64)
        return b"".join([sizes.tobytes(), np.float64(self.norm).tobytes(), self.ids.astype(np.int64).tobytes(), *(x.astype(np.float64).tobytes() for x in (self.vectors, self.points, self.low, self.high)), self.bounds.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        n, width, m, leaves = np.frombuffer(raw, np.int64, 4).tolist()
        self, at = cls.__new__(cls), 40
        self.norm, self.verified = float(np.frombuffer(raw, np.float64, 1, 32)[0]), 0
        for name, kind, shape in (("ids", np.int64, (n,)), ("vectors", float, (n, width)), ("points", float, (n, m)), ("low", float, (leaves, m)), ("high", float, (leaves, m)), ("bounds", np.int64, (leaves, 2))):
            setattr(self, name, np.frombuffer(raw, kind, math.prod(shape), at).reshape(shape))
            at += 8 * math.prod(shape)
        return self

    def search(self, query_id: int, query: np.ndarray, k: int, bound: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the k nearest found of at least ``bound``, nearest first."""
        norm, scale = self.norm, self.norm / math.sqrt(query @ query)
        image = query_images(query[None, :], norm)[0]
        distance = box_distances(self.low, self.high, image)
        leaves = np.argsort(distance, kind="stable")
        # Squared image distance up to which vectors are verified, for a k-th product.
        limit = lambda kth: math.inf if kth == -math.inf else reach() * max(2 * norm * norm - 2 * scale * kth, 1e-9 * norm * norm)
        rows, scores, kth, i, step = np.zeros(0, np.int64), np.zeros(0), bound, 0, 2 if bound == -math.inf else 16
        while i < len(leaves) and distance[leaves[i]] <= limit(kth):
            some = np.sort(leaves[i : i + step])
            i, step = i + len(some), step * 2
            new = np.concatenate([np.arange(*self.bounds[leaf]) for leaf in some])
            if kth > -math.inf:
                gap = self.points[new] - image
                new = new[np.einsum("ij,ij->i", gap, gap) <= limit(kth)]
            self.verified += len(new)
            new = new[self.ids[new] != query_id]
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.vectors[new] @ query))
            if len(rows) >= k:
                kth = max(bound, np.partition(scores, len(scores) - k)[len(scores) - k])
                # Products of one vector may differ in their last bits with its neighbours; what ties within that stays.
                near = scores >= kth - 1e-9 * (1 + abs(kth))
                rows, scores = rows[near], scores[near]
        # einsum adds up in one order wherever a vector lies, so equal vectors have equal scores.
        exact = np.einsum("ij,j->i", self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows[best]], exact[best]


class Cells:
    """Splits the images' space by a kd-tree of ``depth`` levels; equal images lie in one cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        todo = [(1, sample)]
        while todo:
            node, own = todo.pop()
            if node >= 1 << depth:
                continue
            if len(own):
                self.axis[node] = int(np.ptp(own, axis=0).argmax())
                self.value[node] = float(np.median(own[:, self.axis[node]]))
            right = own[:, self.axis[node]] > self.value[node]
            todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Index:
    """The shards of vectors of one length: files in the shared folder, and their bounding boxes."""

    width: int
    norm: float
    paths: list[str]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, base: DataFrame, width: int, n: int, norm: float) -> Index:
        """Of ``n`` rows (id, v) of ``width`` components and a norm of at most ``norm``."""
        spark, folder = base.sparkSession, fresh_dir(base.sparkSession, "neighbours")

        def projected(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"image": pa.array(list(images(_matrix(batch.column(0)), norm)), pa.list_(pa.float64()))})

        step = max(1, n // SAMPLE)
        some = base.where(F.pmod(F.xxhash64("id", "v"), F.lit(step)) == 0).select("v").mapInArrow(projected, "image array<double>").limit(2 * SAMPLE)
        sample = np.array([r.image for r in some.collect()]).reshape(-1, DIMENSIONS)
        depth = max(0, min(math.ceil(math.log2(n / SHARD)), int(math.log2(max(1, len(sample) / 16)))))
        cells = Cells(sample, depth)

        def counted(batches):
            total = np.zeros(1 << depth, np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount(cells.of(images(_matrix(batch.column(0)), norm)), minlength=len(total))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.flatnonzero(total), pa.int64()), "n": pa.array(total[total > 0], pa.int64())})

        counts = base.select("v").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
        size = np.zeros(1 << depth, np.int64)
        for r in counts:
            size[r.cell] = r.n
        # A cell's rows go to as many shards as they fill.
        shares = np.maximum(1, -(-size // (2 * max(SHARD, n >> depth))))
        first = np.cumsum(shares) - shares

        def dealt(batches):
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column(0).to_numpy()
                    cell = cells.of(images(_matrix(batch.column(1)), norm))
                    salt = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(5)) % shares[cell].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(first[cell] + salt, pa.int64()), batch.column(0), batch.column(1)], names=["shard", "id", "v"])

        def written(batches):
            forget()
            for rows in _grouped(batches, 1):
                shard = Shard(rows.column(1).to_numpy(), _matrix(pa.concat_arrays(rows.column(2).chunks)), norm)
                path = write_new(folder, ".shard", shard.dump())
                yield pa.RecordBatch.from_pydict({"path": [path], "low": pa.array([shard.low.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([shard.high.max(axis=0)], pa.list_(pa.float64()))})
            forget()

        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shares.sum()) // 8)
        shards = base.select("id", "v").mapInArrow(dealt, "shard long, id long, v array<double>").repartition(parts, "shard").sortWithinPartitions("shard")
        rows = sorted(save(shards.mapInArrow(written, "path string, low array<double>, high array<double>"), "neighbour-shards").collect())  # a row a shard
        return cls(width, norm, [r.path for r in rows], np.array([r.low for r in rows]), np.array([r.high for r in rows]))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): at least the k nearest found of each query (id, v)."""
        parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        paths, low, high, norm = self.paths, self.low, self.high, self.norm
        blocks = max(1, -(-asked.count() // QUERIES))

        def first(batches):
            for batch in batches:
                if batch.num_rows:
                    near = [int(box_distances(low, high, image).argmin()) for image in query_images(_matrix(batch.column(1)), norm)]
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), batch.column(2), *batch.columns[:2], pa.array([None] * len(near), pa.float64())], names=["shard", "block", "id", "v", "bound"])

        def others(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(2))
                for i, (image, done, score) in enumerate(zip(query_images(v, norm), batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                    full = len(score) >= k
                    limit = reach() * max(2 * norm * norm - 2 * norm / math.sqrt(v[i] @ v[i]) * score[-1], 1e-9 * norm * norm) if full else math.inf
                    more = np.flatnonzero(box_distances(low, high, image) <= limit)
                    more = more[more != done]
                    n = len(more)
                    if n:
                        again = pa.array(np.full(n, i), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(more, pa.int64()), batch.column(5).take(again), batch.column(1).take(again), batch.column(2).take(again), pa.array([score[-1] if full else None] * n, pa.float64())], names=["shard", "block", "id", "v", "bound"])

        def meet(batches):
            forget()
            for rows in _grouped(batches, 2):
                with Reader(paths[rows.column(0)[0].as_py()]) as file:
                    shard = Shard.load(file.read(0, file.size))
                ids, v = rows.column(2).to_numpy(), _matrix(pa.concat_arrays(rows.column(3).chunks))
                bounds = [-math.inf if b is None else b for b in rows.column(4).to_pylist()]
                found = [shard.search(int(q), vector, k, b) for q, vector, b in zip(ids, v, bounds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).combine_chunks(), rows.column(2).combine_chunks(), pa.array(list(v), pa.list_(pa.float64())), pa.array([i for i, _ in found], pa.list_(pa.int64())),
                        pa.array([s for _, s in found], pa.list_(pa.float64())), rows.column(1).combine_chunks(),
                    ],
                    names=["shard", "id", "v", "ids", "scores", "block"],
                )
            forget()

        step = "shard long, block long, id long, v array<double>, bound double"
        hits = "shard long, id long, v array<double>, ids array<long>, scores array<double>, block long"
        met = lambda rows: rows.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block").mapInArrow(meet, hits)
        own = asked.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"))
        begun = save(met(own.mapInArrow(first, step)), "nearest-shards")
        rest = met(begun.select("shard", "id", "v", "ids", "scores", "block").mapInArrow(others, step))
        both = begun.select("id", "ids", "scores").union(rest.select("id", "ids", "scores"))
        return both.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k nearest found."""

    def typed(df: DataFrame) -> DataFrame:
        wide = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        return wide.where(F.col("id").isNotNull() & usable(F.col("v")))

    base, asked = typed(vectors), typed(queries).dropDuplicates(["id", "v"])
    squares = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    widths = base.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(squares).alias("norm")).orderBy("width").collect()  # a row a length
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in widths:
        of = lambda df: df.where(F.size("v") == r.width)  # noqa: B023, E731
        if not of(asked).isEmpty():
            found = found.union(Index.build(of(base), r.width, r.n, r.norm * (1 + 1e-9)).search(of(asked), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grouped(batches, keys: int):
    """The rows of each value of the first ``keys`` columns, which come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        if not len(key):
            continue
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cut, cut[1:], strict=False):
            if last is not None and tuple(key[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


@batched
def op5_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
