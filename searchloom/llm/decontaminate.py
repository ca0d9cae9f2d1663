"""Benchmark decontamination over suffix arrays of the training texts.

Words: A-Z lower-cased, then runs of ``[0-9a-z]`` and non-ASCII characters.
Every shard (a block of documents in a task) gets a suffix array over its words,
sorted to ``window`` words by prefix doubling.  All windows of the benchmark are
binary-searched in it together; the range found for one holds every place where
it occurs.  Places whose words the hashes call equal are compared byte for byte.
Consecutive windows at consecutive places join into the longest verbatim matches.

There is no shuffle of documents: a document meets the whole benchmark where it is
read.  Executors cut the benchmark into blocks of at most ``BLOCK_BYTES`` of text
and write each with its windows to the shared folder; the driver holds a path a
block.  A task searches its shard's suffix array for one block after another, so
what it holds has a fixed bound.

Defined cases: a null text has no words, is hit by nothing and is not
contaminated; items without words (or null) match nothing; an item of fewer
words than the window is one window; equal windows of several items count for
each; an item whose id is null hits words as any other, but is no item of
n_items and items_sha256; rows of the same id are judged apart; other columns
pass through, but for those with the name of a new one, which it replaces.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import forget
from .common import batched, besides, fresh_dir, read_table, save, unused
from .files import Reader, write_new
from .textbytes import Words, blocks

WINDOW = 13
BLOCK_BYTES = 16_000_000
#: Bytes of text under one suffix array.
SHARD = 1_000_000


@dataclass
class Benchmark:
    """The distinct windows of a block of items."""

    ids: list[int | None]
    words: np.ndarray  # (windows, window) word hashes, 0 after a short one
    size: np.ndarray  # words of each window
    raw: list[bytes]  # the words of each window, lower-cased, a blank between
    #: Windows of items: item's index and first word, in the order of ``at``, grouped by window.
    item: np.ndarray
    place: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], window: int) -> Benchmark:
        w = Words([(text or "").encode("utf-8", "surrogatepass") for _, text in items]) if items else Words([b""])
        raw_words = [w.raw[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        known: dict[bytes, int] = {}
        words, size, raw, found = [], [], [], []
        for i in range(len(items)):
            lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
            for s in range(lo, max(hi - window + 1, lo + (hi > lo))):
                e = min(s + window, hi)
                key = b" ".join(raw_words[s:e])
                if key not in known:
                    known[key] = len(raw)
                    raw.append(key)
                    size.append(e - s)
                    words.append(np.concatenate((w.hash[s:e], np.zeros(window - e + s, np.uint64))))
                found.append((known[key], i, s - lo))
        found.sort()
        f = np.array(found, np.int64).reshape(-1, 3)
        at = np.searchsorted(f[:, 0], np.arange(len(raw) + 1))
        return cls([d for d, _ in items], np.array(words, np.uint64).reshape(-1, window), np.array(size, np.int64), raw, f[:, 1], f[:, 2], at)


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``depth`` words (at least), and each position's rank.

    ``words`` are integers with 0 after every document; prefix doubling ranks by
    1, 2, 4 ... words, from the ranks of the two halves.
    """
    order = np.argsort(words)
    known = 1
    rank = _ranks(words[order], order)
    while known < depth:
        pair = rank.astype(np.uint64) << np.uint64(32)
        pair[:-known] |= rank[known:].astype(np.uint64)
        order = np.argsort(pair)
        rank = _ranks(pair[order], order)
        known *= 2
    return order, rank


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return rank


def search(words: np.ndarray, order: np.ndarray, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern the range of ``order`` whose suffixes begin with it."""
    padded = np.concatenate((words, np.zeros(patterns.shape[1], words.dtype)))
    step = np.arange(patterns.shape[1])
    used = step[None, :] < size[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            text = padded[order[mid][:, None] + step]
            differs = (text != patterns[live]) & used[live]
            first = differs.argmax(axis=1)
            row = np.arange(len(live))
            equal = ~differs[row, first]
            before = text[row, first] < patterns[live, first]
            right = (equal & upper) | (~equal & before)
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo

    return bound(False), bound(True)


class Shard:
    """The words of a block of documents under a suffix array."""

    def __init__(self, w: Words, window: int):
        self.w = w
        # A 0 after every document keeps windows inside it.
        at = np.arange(len(w.hash)) + w.doc
        self.words = np.zeros(len(w.hash) + len(w.count), np.uint64)
        self.words[at] = w.hash
        self.back = np.zeros(len(self.words), np.int64)
        self.back[at] = np.arange(len(w.hash))
        self.order, _ = suffix_array(self.words, window)
        self.raw = w.raw.tobytes()


def occurrences(shard: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word position in the shard) of every verbatim occurrence."""
    w, back, raw = shard.w, shard.back, shard.raw
    if not len(w.hash) or not len(bench.raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = shard.order
    lo, hi = search(shard.words, order, bench.words, bench.size)
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    spots = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    place = back[order[spots]]
    same = [
        b" ".join(raw[w.start[j] : w.end[j]] for j in range(p, p + bench.size[k])) == bench.raw[k]
        for k, p in zip(which.tolist(), place.tolist(), strict=True)
    ]
    keep = np.array(same, bool) if same else np.zeros(0, bool)
    return which[keep], place[keep]


def longest_matches(w: Words, bench: Benchmark, which: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Maximal verbatim matches: (row, item's index, first word in the row, first word in the item, words)."""
    spans: list[tuple[int, int, int, int, int]] = []
    for k, p in zip(which.tolist(), place.tolist(), strict=True):
        row = int(w.doc[p])
        for j in range(bench.at[k], bench.at[k + 1]):
            spans.append((row, int(bench.item[j]), p - int(w.bounds[row]) - int(bench.place[j]), int(bench.place[j]), int(bench.size[k])))
    out: list[list[int]] = []
    for row, item, diagonal, place_in_item, size in sorted(set(spans)):
        last = out[-1] if out else None
        if last and last[:3] == [row, item, diagonal] and place_in_item <= last[3] + last[4]:
            last[4] = max(last[4], place_in_item + size - last[3])
        else:
            out.append([row, item, diagonal, place_in_item, size])
    return [(row, item, diagonal + first, first, size) for row, item, diagonal, first, size in out]


def write_benchmark(benchmark: DataFrame, window: int) -> list[str]:
    """Writes the items' windows in blocks of bounded size; the blocks' paths (a row a block)."""
    folder, limit = fresh_dir(benchmark.sparkSession, "benchmark"), BLOCK_BYTES

    def write(batches):
        items, total = [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"path": [write_new(folder, ".windows", pickle.dumps(Benchmark.of(items, window)))]})

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(text.encode("utf-8", "surrogatepass"))
                if items and total + size > limit:
                    yield flush()
                    items, total = [], 0
                items.append((i, text))
                total += size
        if items:
            yield flush()

    texts = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t <> ''")
    return sorted(r.path for r in save(texts.mapInArrow(write, "path string"), "benchmark-blocks").collect())


#: Benchmark blocks that a task keeps.
CACHED = 2


@lru_cache(maxsize=CACHED)
def _block(path: str) -> Benchmark:
    with Reader(path) as file:
        return pickle.loads(file.read(0, file.size))


MATCH = "array<struct<item_id: bigint, doc_word: int, item_word: int, n_words: int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
#: What a verdict adds to a document.
VERDICT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_VERDICT = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType())


def verdict(n_words: int, matches: list[dict]) -> tuple[int, int, int, str, bool]:
    """Words, words inside any match, items with an id, their digest, and whether at least a twentieth of the words is hit."""
    hit, reached = 0, 0
    for start, end in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in matches):
        hit += max(0, end - max(start, reached))
        reached = max(reached, end)
    items = sorted({str(m["item_id"]) for m in matches if m["item_id"] is not None})
    return n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, columns: list[str] | None = None, names: tuple[str, ...] = VERDICT, matches: str | None = None) -> DataFrame:
    """``columns`` (all, by default) of ``docs`` with the verdict's columns under ``names``.

    ``matches``: the name of a further column with the longest verbatim matches
    of at least a window (or a whole short item): item, places, words.
    """
    new = (*names, *((matches,) if matches else ()))
    kept = [i for i in besides(docs, new) if columns is None or docs.columns[i] in columns]
    place = {i: k for k, i in enumerate(kept)}
    at = place.get(docs.columns.index(text), len(kept))
    end = T.StructType([
        *(T.StructField(docs.columns[i], docs.schema[i].dataType) for i in kept), *(T.StructField(n, k) for n, k in zip(names, _VERDICT, strict=True)),
        *([T.StructField(matches, T.DataType.fromDDL(MATCH))] if matches else []),
    ])
    paths = write_benchmark(benchmark, window)

    def run(batches):
        forget()
        for batch in batches:
            count, found = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            shards = ((first, last, Shard(Words(raw), window)) for first, last, raw in blocks(batch.column(at), SHARD))
            # Benchmark blocks that stay in memory meet a shard at a time; of more, each is read once for all of the batch's shards.
            for group in ([s] for s in shards) if len(paths) <= CACHED else [list(shards)]:
                for path in paths:
                    bench = _block(path)
                    for first, _, shard in group:
                        for row, item, d, i, n in longest_matches(shard.w, bench, *occurrences(shard, bench)):
                            found[first + row].append({"item_id": bench.ids[item], "doc_word": d, "item_word": i, "n_words": n})
                for first, last, shard in group:
                    count[first:last] = shard.w.count.tolist()
            judged = list(zip(*map(verdict, count, found), strict=True)) or [[]] * len(VERDICT)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [*(batch.column(i) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(judged, kinds, strict=True)), pa.array(found, _MATCH)]
            yield pa.RecordBatch.from_arrays(arrays[: len(end.names)], names=end.names)
        _block.cache_clear()
        forget()

    read = docs.select(*(F.col(f"`{docs.columns[i]}`").alias(f"c{i}") for i in kept), *([F.col(f"`{text}`").cast("string").alias("text")] if at == len(kept) else []))
    return read.mapInArrow(run, end)


@batched
def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, read_table(spark, sf_dir, "benchmark"), columns=["doc_id"])


@batched
def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    names = tuple(unused(docs, f"_{n}") for n in VERDICT)
    return judge(docs, read_table(spark, sf_dir, "benchmark"), names=names).where(~F.col(names[-1])).drop(*names)
