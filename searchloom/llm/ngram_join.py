"""N-gram Jaccard join: a MinHash LSH forest and exact verification.

1. Documents with one sequence of words (by SHA-256 of the words) form a class,
   and only one representative of a class is compared.
2. A representative's shingles (five words) give a signature: in each of ``TREES``
   trees a path of ``LEVELS`` min-hashes.
3. Every tree is dealt out by the shortest prefix that is ever needed
   (``depth_for``), the root of a subtree; a task sorts a subtree's paths, which is
   its trie, and reads each path's longest matched prefix off its neighbours.  It
   begins with the nodes of whole paths and shortens the prefix level by level:
   a node's members that aren't yet in one component, and didn't meet in a longer
   prefix, are compared by their signatures and linked if they may be similar.
   Shortening ends where all members are one component, or else where pairs at
   the threshold have met in some tree with the target recall.
   A subtree of any size is salted into bounded blocks, and only subtrees that
   still hold several components after all trees' blocks are compared block
   against block.  A spanning forest leaves each block, never its pairs.
4. Within the components all pairs are verified exactly on their shingle sets,
   block against block, as products of sparse 0/1 matrices.  What leaves is each
   document's number of links and a spanning forest of the verified links, whose
   components are the result's classes.  To count a document's links takes all
   pairs of its component's texts, so this work is quadratic in a component.

Nothing is collected to the driver but a few counts, and no pair is emitted.

Words are lower-cased runs of ``[0-9a-z]`` and non-ASCII characters.  Defined
cases: a text of fewer than five words, but not none, has one shingle, all its
words; null texts and texts without words link to nothing and have their own
class; rows of one doc_id are one document each, and have one class; null
doc_ids keep their row, with class null and 0 links; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import forget
from .common import batched, read_table, save, unused
from .components import components
from .line_dedup import numbered
from .textbytes import Words, blocks, mix, prefix_hash, shingles, span_hash

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.99999
TREES, LEVELS = 32, 8
#: Signature estimate from which a pair may be similar: six standard deviations below the threshold.
SLACK = 6
#: Representatives compared at once, and those (and bytes of their shingles) that a task meets another block of.
BLOCK, VERIFY, VERIFY_BYTES = 256, 2048, 8_000_000


def depth_for(threshold: float, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix under which pairs at ``threshold`` meet, in some tree, with ``recall``."""
    depth = levels
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@lru_cache(maxsize=1)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seed[:n] | np.uint64(1)).astype(np.uint32) | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x (TREES * LEVELS) min-hashes of rows' shingle hashes (rows in order; a row without any: all ones)."""
    out = np.full((n, TREES * LEVELS), 0xFFFFFFFF, np.uint32)
    if len(doc):
        rows, first = np.unique(doc, return_index=True)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(x)
        for k, (a, b) in enumerate(zip(*_hashes(TREES * LEVELS), strict=True)):
            np.multiply(x, a, out=work)
            np.add(work, b, out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
            out[rows, k] = np.minimum.reduceat(work, first)
    return out


def _identity(w: Words) -> list[bytes]:
    """The SHA-256 of each row's words, a blank after each."""
    plain = w.raw.copy()
    edge = np.zeros(len(plain) + 1, np.int8)
    edge[w.start] = 1
    edge[w.end + 1] = -1  # a word and the byte after it
    edge[w.start[1:][w.start[1:] == w.end[:-1] + 1]] = 0
    plain[w.end] = 32
    kept = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    size = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))[w.bounds]
    words = plain[kept].tobytes()
    return [hashlib.sha256(words[a:b]).digest() for a, b in zip(size.tolist(), size[1:].tolist(), strict=False)]


def _signed(depth: int):
    def run(batches):
        forget()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, raw in blocks(batch.column(1)):
                w = Words(raw)
                n = end - first
                doc, hashes = shingles(w, WIDTH)
                sig = signatures(doc, hashes, n)
                same = _identity(w)
                some = np.flatnonzero(w.count > 0)
                labels = sig.reshape(n, TREES, LEVELS)[:, :, :depth].astype(np.uint64)
                key = np.tile(np.arange(TREES, dtype=np.uint64), (n, 1))
                for level in range(depth):
                    key = mix(key + labels[:, :, level] + np.uint64(1))
                low8 = mix(sig.astype(np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[first + i] for i in some], pa.int64()),
                        pa.array([same[i] for i in some], pa.binary()),
                        pa.array(w.count[some], pa.int64()),
                        pa.array([low8[i].tobytes() for i in some], pa.binary()),
                        pa.array(list(key[some].view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "same", "n_words", "sig", "keys"],
                )
        forget()

    return run


class _Forest:
    """Union-find over a group's rows; ``link`` says whether the edge joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _grouped(batches, keys: int):
    """Columns of each run of rows that agree in the first ``keys`` columns (rows come sorted by them)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        key = np.stack([table.column(i).to_numpy() for i in range(keys)], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held


def _trie_links(sig: np.ndarray, tree: int, own: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among a subtree's rows (``own``: the components they are in), longest matched prefixes first."""
    path = sig[:, tree * LEVELS : (tree + 1) * LEVELS]
    order = np.lexsort(path.T[::-1])
    differs = path[order[1:]] != path[order[:-1]]
    matched = np.where(differs.any(axis=1), differs.argmax(axis=1), LEVELS)
    sig = sig[order]
    forest, left = _Forest(int(own.max()) + 1), int(own.max()) + 1
    own = own[order]
    need = (THRESHOLD - SLACK * (THRESHOLD * (1 - THRESHOLD) / sig.shape[1]) ** 0.5) * sig.shape[1]
    links, child = [], np.arange(len(order))
    for level in range(LEVELS, depth - 1, -1):
        if left == 1:
            break
        if level > matched.max():
            continue
        bounds = [0, *(np.flatnonzero(matched < level) + 1).tolist(), len(order)] if level > depth else [0, len(order)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a < 2 or child[a] == child[b - 1]:
                continue
            for i in range(a + 1, b):
                new = a + np.flatnonzero(child[a:i] != child[i])  # those that met in a longer prefix are known
                if not len(new):
                    continue
                for j in new[(sig[new] == sig[i]).sum(axis=1) >= need].tolist():
                    if forest.link(int(own[i]), int(own[j])):
                        left -= 1
                        links.append((int(order[i]), int(order[j])))
                if left == 1:
                    return links
            child[a:b] = a
    return links


def _near(batches):
    """Spanning edges of representatives whose signatures agree enough, subtree by subtree.

    Columns: group keys (subtree, block), tree, rep, label, sig.  Rows of one label
    are known to be connected; edges join different labels only.
    """
    forget()
    depth = depth_for(THRESHOLD)
    u, v = [], []
    for group in _grouped(batches, 2):
        if group.num_rows < 2:
            continue
        _, own = np.unique(group.column(4).to_numpy(), return_inverse=True)
        if own.max() == 0:
            continue
        rep = group.column(3).to_numpy()
        sig = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint8).reshape(len(rep), TREES * LEVELS)
        for i, j in _trie_links(sig, group.column(2)[0].as_py(), own, depth):
            u.append(rep[i])
            v.append(rep[j])
        if len(u) > 50_000:
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            u, v = [], []
    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _shingled(batches):
    """(identity, words, sorted shingle hashes) of texts."""
    forget()
    for batch in batches:
        for first, end, raw in blocks(batch.column(0)):
            w = Words(raw)
            doc, hashes = shingles(w, WIDTH)
            at = np.searchsorted(doc, np.arange(end - first + 1))
            sets = [hashes[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(_identity(w), pa.binary()), pa.array(w.count, pa.int64()), pa.array(sets, pa.binary())], names=["same", "n_words", "shingles"])


def _overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairwise intersections' sizes, and the sets' sizes: the product of a sparse 0/1 matrix with itself."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    column = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
    count = np.diff(np.append(new, len(column)))
    shared = count > 1
    number = np.repeat(np.cumsum(shared) - 1, count)
    keep = np.repeat(shared, count)
    row, number = row[keep], number[keep]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(number, (first, first + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[row[lo:hi], number[lo:hi] - first] = 1
        common += part @ part.T
    return common, size


def _verified(batches):
    """For each block pair: links of its rows (weighted by copies) and a spanning forest of the links.

    Columns: component, pair of blocks (i * 2**31 + j), side (0: block i, 1: block j), rep, copies, shingles.
    """
    forget()
    for group in _grouped(batches, 2):
        if group.num_rows < 2:
            continue
        pair = int(group.column(1)[0].as_py())
        alone = pair >> 31 == pair & 0x7FFFFFFF
        side = group.column(2).to_numpy()
        rep = group.column(3).to_numpy()
        copies = group.column(4).to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group.column(5).to_pylist()]
        links, forest, edges = np.zeros(len(rep), np.int64), _Forest(len(rep)), []
        tiles = [own[i : i + BLOCK] for own in ((np.arange(len(rep)),) if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))) for i in range(0, len(own), BLOCK)]
        for x, first in enumerate(tiles):
            for second in tiles[x:]:
                if not alone and side[first[0]] == side[second[0]]:
                    continue
                both = first if first is second else np.concatenate((first, second))
                common, size = _overlaps([sets[i] for i in both])
                linked = (common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-6) & (common > 0)
                np.fill_diagonal(linked, False)
                if first is not second:
                    linked[: len(first), : len(first)] = linked[len(first) :, len(first) :] = False
                links[both] += linked @ copies[both]
                for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                    if forest.link(int(both[i]), int(both[j])):
                        edges.append((int(rep[both[i]]), int(rep[both[j]])))
        some = np.flatnonzero(links)
        if len(some):
            u = [int(rep[i]) for i in some] + [a for a, _ in edges]
            v = [None] * len(some) + [b for _, b in edges]
            n = [int(links[i]) for i in some] + [0] * len(edges)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(n, pa.int64())})


def _edges_within(rows: DataFrame) -> DataFrame:
    """Runs ``_near`` on (prefix, block, tree, rep, label, sig)."""
    return rows.repartition("prefix", "block").sortWithinPartitions("prefix", "block").mapInArrow(_near, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs``.

    class_id is the least doc_id of the documents connected by links (similarity
    of at least THRESHOLD), n_links how many other documents a document has a
    link with, equal texts included.
    """
    depth = depth_for(THRESHOLD)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = save(ids.where("doc_id is not null").mapInArrow(_signed(depth), "doc_id long, same binary, n_words long, sig binary, keys array<long>"), "signatures")
    least = signed.groupBy("same", "n_words").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("m"), F.count("*").alias("copies"))
    reps = save(least.select("same", "n_words", F.monotonically_increasing_id().alias("rep"), F.col("m.doc_id").alias("first"), "copies", "m.sig", "m.keys"), "classes")
    classes = reps.select("same", "n_words", "rep", "first", "copies")

    # The subtrees: shortest prefixes that at least two representatives share.
    prefixes = reps.select("rep", F.posexplode("keys").alias("tree", "prefix"))
    sizes = prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    met = save(prefixes.join(sizes, "prefix").select("prefix", "tree", "rep", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "prefixes")
    salt = lambda seed: F.pmod(F.xxhash64("rep", "prefix", F.lit(seed)), F.col("blocks"))
    sig = reps.select("rep", "sig")
    first = met.join(sig, "rep").select("prefix", salt(1).alias("block"), "tree", "rep", F.col("rep").alias("label"), "sig")
    edges = save(_edges_within(first).distinct(), "near-edges")
    label = components(edges)

    # Groups of several blocks that still hold several components: every block against every other.
    labelled = met.where("blocks > 1").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("prefix").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("prefix")
    open_rows = labelled.join(mixed, "prefix").withColumn("own", salt(2))
    both = open_rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pair = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    more = save(_edges_within(both.join(sig, "rep").select("prefix", pair.alias("block"), "tree", "rep", "label", "sig")).distinct(), "more-edges")
    if not more.isEmpty():
        edges = edges.union(more)
        label = components(edges)
    label = save(label, "near-components")

    # Exact verification within components, block against block.
    members = label.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "copies", "n_words"), "rep")
    near = classes.join(members.select("rep"), "rep", "left_semi")
    texts = ids.join(near.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("text").mapInArrow(_shingled, "same binary, n_words long, shingles binary")
    sets = texts.join(near.select("same", "n_words", "rep"), ["same", "n_words"]).dropDuplicates(["rep"]).select("rep", "shingles")
    wide = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / VERIFY, F.sum("n_words") * 8 / VERIFY_BYTES)).cast("long").alias("blocks"))
    dealt = members.join(wide, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = dealt.join(save(sets, "shingles"), "rep").select("component", pair.alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "shingles")
    found = save(rows.repartition("component", "pair").sortWithinPartitions("component", "pair").mapInArrow(_verified, "u long, v long, links long"), "verified")

    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("v is not null")).select(F.col("node").alias("rep"), "component")
    named = groups.join(classes.select("rep", "first"), "rep")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("class_id")), "component").select("rep", "class_id")
    of_rep = classes.join(links, "rep", "left").join(named, "rep", "left")
    of_class = of_rep.select("same", "n_words", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_class = signed.select("doc_id", "same", "n_words").join(of_class, ["same", "n_words"]).select("doc_id", "class_id", "n_links")
    # Rows without a word have no signature: those that the signed rows leave over.
    total = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    seen = signed.groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("m"))
    left = total.join(seen, total.doc_id == seen.d, "left").select("doc_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("left")).where("left > 0")
    alone = left.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "left"))).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_class.union(alone)


@batched
def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@batched
def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class of near duplicates the row of least doc_id stays, of equal ids (or none, which come last) the first in the input.

    Rows are told apart by a number of their own, so that rows of one doc_id with
    different texts, and rows without an id, are judged by their texts.
    """
    row = unused(docs, "_row")
    base = numbered(docs, row)
    linked = near_duplicates(base, doc_id=row).where("n_links > 0").select(F.col("doc_id").alias("r"), "class_id")
    members = save(linked.join(base.select(F.col(row).alias("r"), F.col("doc_id").alias("d")), "r"), "near-members")
    first = F.min(F.struct(F.col("d").isNull().alias("no_id"), "d", "r"))
    kept = save(members.groupBy("class_id").agg(first.alias("first")).select("class_id", F.col("first.r").alias("kept")), "near-kept")
    gone = members.join(kept, "class_id").where("r <> kept").select(F.col("r").alias(row))
    return base.join(gone, row, "left_anti").select(*docs.columns)
