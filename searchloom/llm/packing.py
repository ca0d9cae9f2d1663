"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens, in the order of the input's rows.  A sequence of
``length`` tokens takes from each source its share, the source's part of all
tokens: a source is credited ``length x share`` each sequence, sends the whole
tokens of its credit, and keeps the rest as a deficit; slots left by rounding go
to the largest deficits.  So every sequence, not only the average one, has the
target proportions to within a token or so for each source.

Groups of ``SPAN`` sequences are packed in parallel.  Which tokens of each queue a
group gets, and the deficits handed over from group to group, follow from the
queues' sizes by arithmetic (``Plan``); within a group the round-robin runs over
its sequences.  Only the sources' sizes, a row a source, reach the driver.  Ids
are written to files where they are made, and read by range where they are
packed; what is shuffled is a row a piece of a document.

The last tokens, fewer than ``length``, fill sequences whose lengths are powers
of two, which need no padding.  So no sequence is padded at all.

Defined cases: null and empty texts are the end id alone; a null source is a
queue of its own; rows of one doc_id are packed apart; an empty table gives no
rows; a source of any size is spread over all groups; pieces carry doc_id and
source, and no other column of the input.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import encoder, forget
from .common import batched, fresh_dir, read_table, save
from .files import Reader, write_new

LENGTH = 2048
#: Sequences packed by one group: 512 x 2048 tokens are 4 MB.
SPAN = 512
#: Tokens of a task that are written at once.
FLUSH = 4_000_000


def round_robin(credit: np.ndarray, left: np.ndarray, slots: int) -> np.ndarray:
    """Whole tokens each queue sends now; ``credit`` falls by them in place.

    ``credit`` holds quantum plus deficit of each queue.  No queue sends more
    than it has left; slots that rounding or a dry queue frees go to the queues
    by largest credit.
    """
    send = np.minimum(np.maximum(np.floor(credit + 1e-9), 0), left).astype(np.int64)
    over = int(send.sum()) - slots
    while over > 0:
        i = int(np.argmin(np.where(send > 0, credit - send, np.inf)))
        back = min(over, int(send[i]), max(1, over // len(send)))
        send[i] -= back
        over -= back
    free = -over
    while free > 0:
        rest = np.where(left > send, credit - send, -np.inf)
        i = int(np.argmax(rest))
        if rest[i] == -np.inf:
            break
        more = min(int(left[i] - send[i]), max(1, min(free, int(rest[i])) if rest[i] >= 1 else 1), free)
        send[i] += more
        free -= more
    credit -= send
    return send


def tail_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Powers of two below ``length`` that add up to ``n`` < ``length``."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if n >> b & 1]


class Plan:
    """Which tokens of every queue each group gets, by arithmetic alone.

    A phase is a stretch in which the target proportions stay the same: one
    phase if they are the queues' own, else one more whenever a queue runs dry.
    The first x tokens of a phase are split down a balanced tree over the queues:
    of a node's x tokens the left half gets its share, rounded, and the right
    half the rest.  One token more adds one token to one queue, so no queue ever
    sends fewer for a larger x, and each is within about a token of its share;
    what it is short of, a group hands to the next as a deficit.  A bound takes a
    walk down the tree, and a group's width grows with the number of queues only
    as that many sequences.
    """

    def __init__(self, sizes: list[int], length: int, span: int, weights: list[float] | None = None):
        self.length, self.width = length, length * max(span, len(sizes))
        self.ends = list(sizes)
        #: (first group, first sequence, first token of each queue, sums of the queues' tokens before each, groups)
        self.phases: list[tuple[int, int, list[int], list[int], int]] = []
        group = sequence = 0
        first, left = [0] * len(sizes), list(sizes)
        while sum(left):
            take = self._until_dry(left, weights) if weights else list(left)
            groups = max(1, sum(take) // self.width)
            self.phases.append((group, sequence, list(first), [0, *accumulate(take)], groups))
            group += groups
            full, rest = divmod(sum(take), length)
            sequence += full + len(tail_lengths(rest, length))
            first = [f + t for f, t in zip(first, take, strict=True)]
            left = [n - t for n, t in zip(left, take, strict=True)]
        self.groups = group
        self._starts = [p[0] for p in self.phases]

    @staticmethod
    def _until_dry(left: list[int], weights: list[float]) -> list[int]:
        live = [w if n else 0.0 for n, w in zip(left, weights, strict=True)]
        if not any(live):
            return list(left)
        factor = min(n / w for n, w in zip(left, live, strict=True) if w)
        dry = {i for i, (n, w) in enumerate(zip(left, live, strict=True)) if w and n / w <= factor}
        return [n if i in dry else min(n, int(w * factor)) for i, (n, w) in enumerate(zip(left, live, strict=True))]

    def _phase(self, group: int) -> tuple[int, int, list[int], list[int], int]:
        return self.phases[bisect.bisect_right(self._starts, group) - 1]

    @staticmethod
    def _sent(sums: list[int], x: int, s: int) -> int:
        """How many of a phase's first ``x`` tokens are queue ``s``'s."""
        a, b = 0, len(sums) - 1
        while b - a > 1:
            m = (a + b) // 2
            total = sums[b] - sums[a]
            left = (2 * (sums[m] - sums[a]) * x + total) // (2 * total) if total else 0
            if s < m:
                x, b = left, m
            else:
                x, a = x - left, m
        return x

    def bound(self, s: int, group: int) -> int:
        """The first token of queue ``s`` that belongs to ``group`` or a later one."""
        if group >= self.groups:
            return self.ends[s]
        g0, _, first, sums, _ = self._phase(group)
        return first[s] + self._sent(sums, (group - g0) * self.width, s)

    def group_of(self, s: int, at: int) -> int:
        return bisect.bisect_right(range(self.groups + 1), at, key=lambda g: self.bound(s, g)) - 1

    def sequence(self, group: int) -> int:
        """The first sequence of a group."""
        g0, sequence, *_ = self._phase(group)
        return sequence + (group - g0) * (self.width // self.length)

    def state(self, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and end token of each queue, the deficits handed over, and the shares."""
        g0, _, first, sums, _ = self._phase(group)
        lo, hi = (np.array([self.bound(s, g) for s in range(len(first))], np.int64) for g in (group, group + 1))
        share = np.diff(sums) / sums[-1]
        return lo, hi, share * ((group - g0) * self.width) - (lo - np.array(first)), share


def group_schedule(start: np.ndarray, end: np.ndarray, deficit: np.ndarray, share: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(sequence in the group, offset, queue, first token in the queue, tokens), in order."""
    out, at, credit, w = [], start.copy(), deficit.copy(), 0
    full = int((end - start).sum()) // length
    lengths = [length] * full + tail_lengths(int((end - start).sum()) % length, length)
    for slots in lengths:
        credit += share * slots
        send = round_robin(credit, end - at, slots)
        offset = 0
        for s in np.flatnonzero(send):
            out.append((w, offset, int(s), int(at[s]), int(send[s])))
            offset += int(send[s])
        at += send
        w += 1
    return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row a document, and its ids with the end id in a file: doc_id, source, n, part, local, file, offset (bytes), width (bytes an id).

    ``part`` is the task, ``local`` how many tokens of the source it had before the
    document.  A file holds a task's ids in stretches of about FLUSH, each
    source's one after another, so that a queue's neighbours are neighbours there.
    """
    folder = fresh_dir(docs.sparkSession, "packing-ids")
    names = ("doc_id", "source", "n", "part", "local", "file", "offset", "width")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())

    def rows(batches):
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        width, end = int(kind[2]), np.array([end_id], kind)
        part, sent = TaskContext.get().partitionId(), Counter()
        held: dict[str | None, list[tuple]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            file = write_new(folder, ".ids", (b"".join(ids for *_, some in own for ids in (some.tobytes(), end.tobytes())) for own in held.values()))
            out, at = [], 0
            for source, own in held.items():
                for d, n, local, _ in own:
                    out.append((d, source, n, part, local, file, at, width))
                    at += n * width
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                flat, at = enc.encode(some.column(2).to_pylist())
                flat = flat.astype(kind)
                for i, (d, source) in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
                    n = int(at[i + 1] - at[i]) + 1
                    held.setdefault(source, []).append((d, n, sent[source], flat[at[i] : at[i + 1]]))
                    sent[source] += n
                    size += n
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    fields = "doc_id long, source string, n long, part long, local long, file string, offset long, width int"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(rows, fields)


def _read_queues(rows: list[tuple]) -> dict[int, np.ndarray]:
    """The ids of a group's pieces by queue, in their order; neighbours in a file are one range read."""
    spans: dict[int, list[list]] = {}
    for _, queue, _, _, _, _, length, file, offset, width in rows:
        own = spans.setdefault(queue, [])
        if own and own[-1][0] == file and own[-1][1] + own[-1][2] == offset:
            own[-1][2] += length * width
        else:
            own.append([file, offset, length * width, width])
    open_files: dict[str, Reader] = {}
    out = {}
    for queue, own in spans.items():
        parts = []
        for file, offset, size, width in own:
            if file not in open_files:
                if len(open_files) >= 64:
                    open_files.pop(next(iter(open_files))).close()
                open_files[file] = Reader(file)
            parts.append(np.frombuffer(open_files[file].read(offset, size), f"<u{width}").astype("<u4"))
        out[queue] = np.concatenate(parts)
    for reader in open_files.values():
        reader.close()
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, span: int = SPAN, mixture: dict | None = None, digest: bool = False) -> DataFrame:
    """One row a piece: doc_id, source, start, length, ids (their CRC-32, ids_crc32, if ``digest``), doc_tokens, sequence_id, offset.

    ``mixture``: weights by source in place of the sources' own sizes; a queue
    that runs dry leaves its slots to the others.  The input's other columns go.
    """
    spark = docs.sparkSession
    tokens = save(tokenize(docs, tokenizer, end_id), "packing-tokens")
    # The queues' positions: every task kept running sums, and starts where the tasks before it end.
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row a task and source: small against the ids, so that Spark may broadcast it, or else sorts both sides.
    base = save(by_part.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")

    totals = sorted(((r.source, r.n) for r in by_part.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))  # a row a source
    names = [s for s, _ in totals]
    plan = Plan([n for _, n in totals], length, span, [mixture.get(s, 0.0) for s in names] if mixture else None)
    queue_of = {s: i for i, s in enumerate(names)}

    def pieces(batches):
        """Cuts each document at the groups' ends: (group, queue, first token, document, its first token there, its tokens, tokens, file, offset, width)."""
        forget()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())
        for batch in batches:
            out = []
            for d, source, n, file, offset, width, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                queue, here = queue_of[source], at
                g = plan.group_of(queue, at)
                while here < at + n:
                    to = min(at + n, plan.bound(queue, g + 1))
                    if to > here:
                        out.append((g, queue, here, d, here - at, n, to - here, file, offset + (here - at) * width, width))
                        here = to
                    g += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "queue", "at", "doc_id", "start", "n", "length", "file", "offset", "width"])

    ids_name, ids_type = ("ids_crc32", "long") if digest else ("ids", "binary")

    def packed(batches):
        """Rows come by group, queue and place; a group's ids lie in memory (its width)."""
        forget()
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] != rows[0][0]:
                    yield from emit(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from emit(rows)

    def emit(rows):
        g = rows[0][0]
        lo, hi, deficit, share = plan.state(g)
        first_sequence = plan.sequence(g)
        data = _read_queues(rows)
        queues: dict[int, list[tuple]] = {}
        for row in rows:
            queues.setdefault(row[1], []).append(row)
        cursor = dict.fromkeys(queues, 0)
        out = []
        for w, offset, queue, at, count in group_schedule(lo, hi, deficit, share, length):
            own, i, first_of_queue = queues[queue], cursor[queue], int(lo[queue])
            while count:
                _, _, first, d, start, n, m, *_ = own[i]
                take = min(count, first + m - at)
                raw = data[queue][at - first_of_queue : at - first_of_queue + take].tobytes()
                out.append((d, names[queue], start + at - first, take, zlib.crc32(raw) if digest else raw, n, first_sequence + w, offset))
                at, offset, count = at + take, offset + take, count - take
                if at == first + m:
                    i += 1
            cursor[queue] = i
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for first in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[first : first + 10_000], strict=True), kinds, strict=True)], names=["doc_id", "source", "start", "length", ids_name, "doc_tokens", "sequence_id", "offset"])

    numbered = tokens.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "n", "file", "offset", "width", (F.col("local") + F.col("base")).alias("at"))
    cut = numbered.mapInArrow(pieces, "g long, queue int, at long, doc_id long, start long, n long, length long, file string, offset long, width int")
    # Dealt by number, so that no task gets more groups than another.
    parts = max(1, min(plan.groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan.groups // 8)))
    grouped = cut.repartitionById(parts, (F.col("g") % parts).cast("int")).sortWithinPartitions("g", "queue", "at")
    return grouped.mapInArrow(packed, f"doc_id long, source string, start long, length long, {ids_name} {ids_type}, doc_tokens long, sequence_id long, offset long")


@batched
def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True).drop("source")


@batched
def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces, packed into sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)
