"""Hard negatives by one-dimensional distance keys: exact searches for inner products in annuli round pivots.

Vectors are made equally long by one more component, so that the largest inner
product with a query is the least distance from it.  A row's key is (its nearest
pivot, its distance from it); rows are stored sorted by key, in blocks that know
their pivot, least and greatest distance and least id.  By the triangle inequality
a row that is d away from a query lies, in every pivot's order, within d of the
query's own distance from the pivot.  A search takes blocks in rings that grow from
there, until what is left can't reach the k-th best found: that bound certifies
the result, so it is exact, ties included.

Positives are the first rows of the anchor's label; for each of them the negatives
are the first rows of other labels whose score lies between a share of the
positive's and the positive's own, so that search has an annulus from the start.

Rows equal in label and components are counted out first: only the least ids of
such a group can be among the first, whatever the query.  Executors write the
sorted store to the shared folder; the driver holds a path a file.  A task has a
block of anchors, reads the directory, then blocks one at a time.

Defined cases: rows without an id, label or vector, with a null or non-finite
component, or one so large that an inner product may exceed a long, take no part;
vectors of different lengths never meet; equal rows count once; a row with the
anchor's own id is none of its others.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import fresh_dir
from .common import batched, read_table, save
from .files import Reader, write_new

#: Pivots, rows of the bounded sample they are fitted on, rows of a stored block, bytes of a file, and anchors of a block.
PIVOTS, SAMPLE, BLOCK, FILE, ANCHORS = 64, 4096, 2048, 32_000_000, 512


def quantised(embedding: Column) -> Column:
    """Components as integers: floor(256 x); null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    limit = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(embedding), F.lit(1))))
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * 256 + 1 > F.least(limit, F.lit(2.0**30))))
    return F.when(embedding.isNotNull() & ~odd, F.transform(wide, lambda x: x.cast("int")))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, int64: by doubles where they hold all sums, else by longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Pivots:
    """Pivots of one vector length, in the space with one more component."""

    def __init__(self, sample: np.ndarray, norm2: int):
        self.norm2 = float(norm2)
        rows = self.lift(sample)
        rng = np.random.default_rng(1)
        self.points = rows[rng.permutation(len(rows))[:PIVOTS]].copy() if len(rows) else np.zeros((1, rows.shape[1]))
        for _ in range(8):
            own = self.distances(rows).argmin(axis=1) if len(rows) else np.zeros(0)
            for p in range(len(self.points)):
                if (own == p).any():
                    self.points[p] = rows[own == p].mean(axis=0)

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", rows, rows), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Rows by pivots."""
        square = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", self.points, self.points) - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _fit(rows: DataFrame) -> dict[int, Pivots]:
    """Pivots by vector length, of at most SAMPLE rows a length, chosen by a hash of their ids; the greatest norm is of all rows."""
    norms = rows.groupBy("width").agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)).alias("norm2")).collect()  # a row a length
    place = F.row_number().over(Window.partitionBy("width").orderBy(F.xxhash64("id"), "id", "label", "v"))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(rows.count() // SAMPLE, 1))) == 0)  # about SAMPLE rows
    sample = some.select("width", "v", place.alias("p")).where(F.col("p") <= SAMPLE).select("width", "v").toArrow()
    out = {}
    for r in norms:
        own = pa.concat_arrays([pa.array([], sample["v"].type), *sample.filter(pc.equal(sample["width"], r.width))["v"].chunks])
        out[r.width] = Pivots(_matrix(own, r.width), r.norm2)
    return out


def _keyed(pivots: dict[int, Pivots]):
    """(width, id, label, v) with pivot and distance; the query's own lifted form has 0 as its last component."""

    def run(batches):
        for batch in batches:
            width = batch.column(0).to_numpy()
            for w in np.unique(width).tolist():
                some = batch.filter(pa.array(width == w))
                d = pivots[w].distances(pivots[w].lift(_matrix(some.column(3), w)))
                pivot = d.argmin(axis=1)
                own = pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])
                yield pa.RecordBatch.from_arrays([*some.columns, *own], names=["width", "id", "label", "v", "pivot", "distance"])

    return run


def _written(folder: str):
    """Writes sorted rows (width, id, label, v, pivot, distance) in blocks, each of one length and pivot; a row a file."""

    def close(blocks: list[tuple], directory: list[tuple]) -> pa.RecordBatch:
        body = io.BytesIO()
        np.save(body, np.array(directory, dtype=[("width", "i4"), ("pivot", "i4"), ("lo", "f8"), ("hi", "f8"), ("least", "i8"), ("at", "i8"), ("n", "i8")]))
        path = write_new(folder, ".keys", (len(body.getvalue()).to_bytes(8, "little"), body.getvalue(), *(x.tobytes() for b in blocks for x in b)))
        return pa.RecordBatch.from_pydict({"path": [path]})

    def run(batches):
        held, n, blocks, directory, at = [], 0, [], [], 0

        def cut(rows: list[pa.RecordBatch]) -> None:
            nonlocal at
            table = pa.Table.from_batches(rows).combine_chunks()
            w, p = table["width"][0].as_py(), table["pivot"][0].as_py()
            d = table["distance"].to_numpy()
            ids, labels = table["id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64)
            v = _matrix(pa.concat_arrays(table["v"].chunks), w).astype(np.int32)
            directory.append((w, p, d.min(), d.max(), ids.min(), at, len(d)))
            blocks.append((ids, labels, v))
            at += len(d) * (16 + 4 * w)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().astype(np.int64) * (PIVOTS + 1) + batch.column(4).to_numpy()
            for piece in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                own, k = batch.slice(piece[0], len(piece)), key[piece[0]]
                if held and held[0] != k:
                    cut(held[1])
                    held, n = [], 0
                while own.num_rows:
                    room = BLOCK - n
                    held = [k, [*(held[1] if held else []), own.slice(0, room)]]
                    n += min(room, own.num_rows)
                    own = own.slice(room)
                    if n == BLOCK:
                        cut(held[1])
                        held, n = [], 0
                if at >= FILE:
                    yield close(blocks, directory)
                    blocks, directory, at = [], [], 0
        if held:
            cut(held[1])
        if directory:
            yield close(blocks, directory)

    return run


class Store:
    """The sorted store as a task reads it: its directory, and blocks by range reads."""

    def __init__(self, paths: list[str], width: int):
        self.width, parts = width, []
        self.paths, self.base = paths, []
        for f, path in enumerate(paths):
            with Reader(path) as file:
                size = int.from_bytes(file.read(0, 8), "little")
                own = np.load(io.BytesIO(file.read(8, size)))
            self.base.append(8 + size)
            own = own[own["width"] == width]
            parts.append((np.full(len(own), f), own))
        self.file = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
        self.blocks = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)

    def read(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, labels and components of a block."""
        n, f = int(self.blocks["n"][b]), self.file[b]
        with Reader(self.paths[f]) as file:
            raw = file.read(self.base[f] + int(self.blocks["at"][b]), n * (16 + 4 * self.width))
        ids, labels = np.frombuffer(raw, np.int64, 2 * n).reshape(2, n)
        return ids, labels, np.frombuffer(raw, np.int32, offset=16 * n).reshape(n, self.width)


class Best:
    """The k first (greatest score, then least id) of each of m searches, kept sorted."""

    def __init__(self, m: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.zeros((m, k), np.int64)
        self.id = np.zeros((m, k), np.int64)
        self.n = np.zeros(m, np.int64)

    def need(self) -> np.ndarray:
        """The least score that may still count, of each search."""
        return np.where(self.n == self.k, self.score[:, -1], self.floor)

    def last(self) -> np.ndarray:
        """The id that a row of just that score must lie below."""
        return np.where(self.n == self.k, self.id[:, -1], np.iinfo(np.int64).max)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(search)
        if not len(touched):
            return
        kept = np.arange(self.k) < self.n[touched, None]
        search = np.concatenate([search, np.repeat(touched, kept.sum(axis=1))])
        score, ids = np.concatenate([score, self.score[touched][kept]]), np.concatenate([ids, self.id[touched][kept]])
        order = np.lexsort((ids, -score, search))
        search, score, ids = search[order], score[order], ids[order]
        first = np.searchsorted(search, touched)
        place = np.arange(len(search)) - np.repeat(first, np.diff(np.append(first, len(search))))
        top = place < self.k
        self.score[search[top], place[top]], self.id[search[top], place[top]] = score[top], ids[top]
        self.n[touched] = np.minimum(np.diff(np.append(first, len(search))), self.k)


def _search(store: Store, pivots: Pivots, vectors: np.ndarray, reach, visit) -> None:
    """Visits the store's blocks in rings that grow from each query's keys.

    ``reach()``: (least score that counts, greatest that counts, id below which a
    row of the least score must lie) of each query; ``visit(which, ids, labels, scores)``.
    """
    if not len(store.blocks) or not len(vectors):
        return
    rows = vectors.astype(np.float64)
    square = np.einsum("ij,ij->i", rows, rows)
    d = pivots.distances(np.column_stack([rows, np.zeros(len(rows))]))[:, store.blocks["pivot"]]
    near = np.maximum(np.maximum(store.blocks["lo"] - d, d - store.blocks["hi"]), 0)
    far = d + store.blocks["hi"]
    room = 1e-7 * (pivots.norm2 + square) + 1
    most = (pivots.norm2 + square[:, None] - near * near) / 2 + room[:, None]
    least = (pivots.norm2 + square[:, None] - far * far) / 2 - room[:, None]
    for b in np.argsort(near.min(axis=0), kind="stable").tolist():
        low, high, below = reach()
        open_ = (most[:, b] > low) | ((most[:, b] >= low) & (store.blocks["least"][b] < below))
        which = np.flatnonzero(open_ & (least[:, b] <= high) & (low <= high))
        if len(which):
            ids, labels, v = store.read(b)
            visit(which, ids, labels, _dot(vectors[which], v))


_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(paths: list[str], pivots: dict[int, Pivots], positives: int, negatives: int, share: tuple[int, int]):
    """Anchors (width, id, label, v) to rows of _FOUND, a block of anchors of one length at a time."""
    everything, nothing = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def block(width: int, anchor: np.ndarray, label: np.ndarray, v: np.ndarray, store: Store) -> pa.RecordBatch:
        m = len(anchor)
        good = Best(m, positives, np.full(m, everything))

        def same(which, ids, labels, score):
            fits = (labels == label[which, None]) & (ids != anchor[which, None]) & (score >= good.need()[which, None])
            q, r = np.nonzero(fits)
            good.add(which[q], score[q, r], ids[r])

        _search(store, pivots[width], v, lambda: (good.need(), np.full(m, nothing), good.last()), same)

        # One search an anchor and positive; a positive below 0 has no room between the share of its score and its score.
        have = np.arange(positives) < good.n[:, None]
        high = np.where(have, good.score, everything)
        exact = high.astype(object) * share[0]
        low = np.array([-(-x // share[1]) if h else nothing for x, h in zip(exact.ravel(), have.ravel(), strict=True)], dtype=object)
        low = np.array([min(max(x, everything), nothing) for x in low], np.int64).reshape(high.shape)
        bad = Best(m * positives, negatives, low.ravel())

        def other(which, ids, labels, score):
            differs, need = (labels != label[which, None]) & (ids != anchor[which, None]), bad.need().reshape(m, positives)
            for j in range(positives):
                q, r = np.nonzero(differs & (score <= high[which, j, None]) & (score >= need[which, j, None]))
                bad.add(which[q] * positives + j, score[q, r], ids[r])

        def reach():
            need, last = bad.need().reshape(m, positives), bad.last().reshape(m, positives)
            wanted = have & (need <= high)
            low = np.where(wanted, need, nothing)
            at = low.argmin(axis=1)
            # Of several searches with the same least score the one that takes the most counts.
            below = np.where(low == low.min(axis=1, keepdims=True), last, everything).max(axis=1)
            return low[np.arange(m), at], np.where(wanted, high, everything).max(axis=1), below

        _search(store, pivots[width], v, reach, other)
        s, k = np.nonzero(np.arange(negatives) < bad.n[:, None])
        a, j = s // positives, s % positives
        columns = anchor[a], good.id[a, j], (k + 1).astype(np.int32), bad.id[s, k], good.score[a, j], bad.score[s, k]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches):
        stores: dict[int, Store] = {}
        for batch in batches:
            width = batch.column(0).to_numpy()
            for w in np.unique(width).tolist():
                some = batch.filter(pa.array(width == w))
                if w not in stores:
                    stores[w] = Store(paths, w)
                ids, labels = (some.column(c).to_numpy().astype(np.int64) for c in (1, 2))
                v = _matrix(some.column(3), w)
                for first in range(0, len(ids), ANCHORS):
                    one = slice(first, first + ANCHORS)
                    yield block(w, ids[one], labels[one], v[one], stores[w])

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id long, label, v array<int>).

    Anchors are the rows of ``is_anchor``, a condition on id and label.  ``share``:
    the part (numerator, denominator) of the positive's score that a negative must
    reach at least.
    """
    spark = rows.sparkSession
    usable = rows.where("id is not null and label is not null and v is not null").select(F.size("v").alias("width"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v")
    each = save(usable.groupBy("width", "id", "label", "v").agg(F.count("*").alias("n")).drop("n"), "vectors")  # equal rows count once
    if each.isEmpty():
        return spark.createDataFrame([], _FOUND)
    place = F.row_number().over(Window.partitionBy("width", "label", "v").orderBy("id"))
    # One more than is asked for, since the anchor may be among them.
    first = each.withColumn("p", place).where(F.col("p") <= max(positives, negatives) + 1).drop("p")
    pivots = _fit(each)
    keyed = save(first.mapInArrow(_keyed(pivots), "width int, id long, label long, v array<int>, pivot int, distance double"), "keyed")
    stored = keyed.agg(F.coalesce(F.sum(4 * F.col("width") + 16), F.lit(0))).first()[0]
    parts = max(math.ceil(stored / FILE), 1)
    folder = fresh_dir(spark, "keys")
    by_key = keyed.repartitionByRange(parts, "width", "pivot", "distance", "id").sortWithinPartitions("width", "pivot", "distance", "id")
    paths = sorted(r.path for r in save(by_key.mapInArrow(_written(folder), "path string"), "key-files").collect())  # a row a file

    # Anchors near one another share a task, so that they read the same blocks.
    anchors = save(each.where(is_anchor).mapInArrow(_keyed(pivots), "width int, id long, label long, v array<int>, pivot int, distance double"), "anchors")
    n = anchors.count()
    tasks = max(math.ceil(n / ANCHORS), min(spark.sparkContext.defaultParallelism, math.ceil(n / 32)), 1)
    asked = anchors.repartitionByRange(tasks, "width", "pivot", "distance", "id").select("width", "id", "label", "v")
    return asked.mapInArrow(_mined(paths, pivots, positives, negatives, share), _FOUND)


@batched
def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("v")), F.col("id") % 100 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, e.id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a, e WHERE a.id % 100 = 0 AND e.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5"""
