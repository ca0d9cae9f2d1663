"""Suffix-array dedup: every byte in a string of ``LENGTH`` bytes that also starts elsewhere goes.

The texts are written once, in shards of some megabytes with their anchors beside
them; every later step moves small rows named by shard, and reads the shards.

1. Anchors.  Every window of LENGTH bytes has an anchor, the least hash among its
   strings of half as many bytes.  Equal windows have equal anchors in the same
   place, so a window can only repeat if its anchor's hash does.  One exchange of
   each shard's distinct hashes, packed, tells the shard which of its anchors
   come again; all other text is out, as a prefix-doubling string sort drops what
   has a unique prefix.
2. Suffixes.  An anchor's context is the suffix that begins at it, up to the end of
   its last window, and then what lies before it, backwards, to its first
   window.  The contexts of the anchors left are sorted in runs, equal ones of a
   run become one, and the front-coded runs are cut at splitters, exchanged and
   merged by a loser tree that compares no known prefix again.
3. Matches.  Contexts of equal anchors are neighbours in the merged order.  Equal
   ones repeat as a whole.  Any other repeats from its first to its last window
   that a neighbour of its class also holds: the windows' hashes name the
   candidates, and their bytes decide.  As all windows of an anchor overlap in
   it, these two windows tell all bytes that go, on both sides.

A string that any number of documents hold is one context a run, and one 64-bit
hash a shard.  Anchors that occur more than ``HOT`` times may have as many
different contexts (a common passage in many hosts); these would be one class in
one task.  So their windows travel one by one instead, dealt by the windows'
hashes, in runs of their own that the same merge compares.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH lose
nothing; strings are judged on the input, and never cross documents; rows of one
doc_id are apart; exact copies of a document lose everything; what is left may
end inside a character, so it is binary; an empty table gives no rows; other
columns pass through, but for those with the name of a new one, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import forget
from .common import batched, besides, fresh_dir, read_table, save
from .files import Reader, write_new
from .merge import decode, front_code, merge, sort_order
from .textbytes import _BYTE, mix, powers, prefix_hash, span_hash

LENGTH = 200
#: Bytes of text in a shard (a longer text is one), and windows whose anchors are found at once.
SHARD, BLOCK = 6_000_000, 1 << 19
#: Contexts sorted as one run.
RUN = 20_000
#: Occurrences from which an anchor's windows travel one by one.
HOT = 10_000
#: Contexts compared at once, but for larger classes, which HOT bounds.
BATCH = 4_000
#: Anchors a part of the exchanges stands for.
PART = 1_000_000


# Anchors of a shard


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of every window of ``width`` lies."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    # The low bits give way to the place, so that one minimum finds both; the same bits whatever n.
    bits = np.uint64((1 << 22) - 1)
    padded[:n] = (h & ~bits) | np.arange(n, dtype=np.uint64)
    forward = np.minimum.accumulate(padded.reshape(-1, width), axis=1).ravel()
    backward = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(backward[:count], forward[width - 1 : width - 1 + count]) & bits).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of texts that lie one after another in ``data``.

    A run of windows may be cut into several anchors at a block's end; they only
    have fewer windows then.
    """
    core, total = length // 2, len(data)
    edge = np.zeros(total + 1, np.int8)
    some = np.diff(bounds) >= length
    edge[bounds[:-1][some]] = 1
    edge[(bounds[1:] - length + 1)[some]] = -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)  # whether a window begins here
    out = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
    for s in range(0, total - length + 1, BLOCK):
        e = min(s + BLOCK, total - length + 1)
        keep = inside[s:e]
        if not keep.any():
            continue
        block = data[s : e + length - 1]
        prefix = prefix_hash(_BYTE[block])
        n = len(block) - core + 1
        h = mix((prefix[core:] - prefix[:-core]) * powers(len(prefix))[1][:n] + np.uint64(core))
        least = _least(h, length - core + 1)
        at = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (keep[1:] != keep[:-1]))))
        last = np.append(at[1:], e - s) - 1
        at, last = at[keep[at]], last[keep[at]]
        out.append((h[least[at]], least[at] + s, at + s, last + s))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# Shards


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after another, and their bounds."""
    array = pa.concat_arrays(column.chunks)
    bounds = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


_MANIFEST = "shard string, anchors string, n long"


def _write_shards(folder: str, length: int):
    """Writes shards (the text is the last column) and their anchors; a row each."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        shard = write_new(folder, ".texts", (sink.getvalue(),))
        data, bounds = _flat(table.column(table.num_columns - 1))
        h, place, first, last = anchors(data, bounds, length)
        beside = write_new(folder, ".anchors", (h.tobytes(), *(x.astype(np.uint32).tobytes() for x in (place, first, last))))
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([beside]), pa.array([len(h)], pa.int64())], names=["shard", "anchors", "n"])

    def run(batches):
        forget()
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.num_columns - 1).nbytes
            if size >= SHARD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
        forget()

    return run


def _read(path: str) -> bytes:
    with Reader(path) as file:
        return file.read(0, file.size)


def _read_shard(path: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(_read(path)).read_all()
    return table, *_flat(table.column(table.num_columns - 1))


def _read_anchors(path: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _read(path)
    # Least hashes are small ones; mixed again they are even over the parts' ranges.
    return mix(np.frombuffer(raw, np.uint64, n)), *(np.frombuffer(raw, np.uint32, n, (8 + 4 * i) * n).astype(np.int64) for i in range(3))


def _grouped(batches, key: int = 0) -> Iterator[list[tuple]]:
    """The rows of each value of a column; rows come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for first in range(0, batch.num_rows, 100):
            for row in zip(*(c.to_pylist() for c in batch.slice(first, 100).columns), strict=True):
                if held and row[key] != held[0][key]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


# Which anchors come again


def _hashes(parts: int):
    """Each shard's distinct hashes and how often they come, cut into ``parts`` ranges: (part, shard, hashes, counts)."""
    step = np.uint64(2**64 // parts + 1)

    def run(batches):
        for batch in batches:
            for shard, path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, count = np.unique(_read_anchors(path, n)[0], return_counts=True)
                cut = np.flatnonzero(np.diff(h // step, prepend=np.uint64(2**64 - 1)))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True):
                    yield _row(_HASHES, int(h[a] // step), shard, h[a:b].tobytes(), np.minimum(count[a:b], 65535).astype("<u2").tobytes())

    return run


_HASHES = (("part", pa.int32()), ("shard", pa.string()), ("h", pa.binary()), ("n", pa.binary()))
_CODES = (("shard", pa.string()), ("part", pa.int32()), ("codes", pa.binary()))


def _row(schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, schema, strict=True)], names=[n for n, _ in schema])


def _codes(hot: int):
    """For each hash of a row: 0 if it comes once in all, 2 if more than ``hot`` times, else 1."""

    def run(batches):
        for rows in _grouped(batches):
            h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            n = np.concatenate([np.frombuffer(r[3], "<u2") for r in rows])
            _, group = np.unique(h, return_inverse=True)
            total = np.bincount(group, n)
            code = ((total > 1).astype(np.uint8) + (total > hot))[group]
            at = 0
            for part, shard, own, _ in rows:
                yield _row(_CODES, shard, part, code[at : at + len(own) // 8].tobytes())
                at += len(own) // 8

    return run


# Runs

#: kind: 0 contexts, 1 intervals known in the shard, 2 windows of hot anchors.
_RUN = (
    ("kind", pa.int32()), ("part", pa.int32()), ("shard", pa.string()), ("common", pa.binary()), ("rest", pa.binary()), ("size", pa.binary()),
    ("many", pa.binary()), ("place", pa.binary()),
)
_RUNS = "kind int, part int, shard string, common binary, rest binary, size binary, many binary, place binary"


def _bytes(x: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def _contexts(padded: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """((n, width) bytes, sizes): each anchor's context, from it on and then backwards, and both parts' sizes (two bytes each).

    ``padded``: the data with ``length`` bytes before and after.
    """
    back = length - length // 2
    right, left = last + length - place, place - first
    parts = np.empty((len(place), length + back + 4), np.uint8)
    parts[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[place + length]
    parts[:, length : length + back] = np.lib.stride_tricks.sliding_window_view(padded, back)[place + length - back][:, ::-1]
    parts[:, length + back :] = np.stack((right, left), axis=1).astype(">u2").view(np.uint8).reshape(-1, 4)
    column = np.arange(length + back + 4)[None, :]
    used = (column < right[:, None]) | ((column >= length) & (column < length + left[:, None])) | (column >= length + back)
    size = right + left + 4
    out = np.zeros_like(parts)
    out[column < size[:, None]] = parts[used]
    return out, size


def _distinct(strings: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct string in it, how many are equal to it)."""
    order = sort_order(strings, size)
    s, n = strings[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1) | (n[1:] != n[:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _sorted_runs(length: int, splitters: list[bytes], parts: int):
    """The runs of each shard, from its row and the codes of its hashes."""
    core = length // 2
    bounds = np.array(splitters, f"S{core}")

    def slices(kind: int, shard: str, strings, size, many, place, part: np.ndarray):
        """The rows of a sorted run; ``part`` of each string."""
        by_part = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[by_part], prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
            own = by_part[a:b]
            common, rest = front_code(strings[own], size[own])
            packed = pa.compress(rest, "zstd", asbytes=True)
            yield _row(_RUN, kind, int(part[own[0]]), shard, common, packed, _bytes(size[own], "<u2"), many[own].tobytes(), _bytes(place[own]))

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (shard, _, path, n, _), *replies = rows
        if not n:
            return
        h, place, first, last = _read_anchors(path, n)
        code = np.concatenate([np.frombuffer(r[4], np.uint8) for r in replies])[np.unique(h, return_inverse=True)[1]]
        _, data, _ = _read_shard(shard)
        padded = np.concatenate((np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)))
        known: list[np.ndarray] = []  # (start, end) of what repeats for certain
        for kind, some in ((0, np.flatnonzero(code == 1)), (2, np.flatnonzero(code == 2))):
            for at in range(0, len(some), RUN):
                own = some[at : at + RUN]
                strings, size = _contexts(padded, place[own], first[own], last[own], length)
                order, head, count = _distinct(strings, size)
                again = own[order[np.repeat(count > 1, count)]]
                known.append(np.stack((first[again], last[again] + length), 1))
                one_of = order[head]
                if kind == 0:
                    s = strings[one_of]
                    part = np.searchsorted(bounds, np.ascontiguousarray(s[:, :core]).view(f"S{core}").ravel(), "right") if len(bounds) else np.zeros(len(s), np.int64)
                    yield from slices(0, shard, s, size[one_of], count > 1, place[own[one_of]], part)
                    continue
                del strings
                for begin in range(0, len(one_of), RUN // 64):
                    piece = own[one_of[begin : begin + RUN // 64]]
                    windows = last[piece] - first[piece] + 1
                    p = np.repeat(first[piece] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
                    settled = np.repeat(count[begin : begin + RUN // 64] > 1, windows)
                    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[p])
                    size_w = np.full(len(w), length)
                    order_w, head_w, count_w = _distinct(w, size_w)
                    twice = p[order_w[np.repeat(count_w > 1, count_w)]]
                    known.append(np.stack((twice, twice + length), 1))
                    many = (count_w > 1) | np.logical_or.reduceat(settled[order_w], head_w)
                    s, at_w = w[order_w[head_w]], p[order_w[head_w]]
                    prefix = prefix_hash(_BYTE[s.ravel()])
                    start = np.arange(len(s)) * length
                    part = (span_hash(prefix, start, start + length) % np.uint64(parts)).astype(np.int64)
                    yield from slices(2, shard, s, size_w[head_w], many, at_w, part)
        found = _union(np.concatenate(known)) if known else np.zeros((0, 2), np.int64)
        if len(found):
            yield _row(_RUN, 1, int(hashlib.md5(shard.encode()).hexdigest()[:7], 16) % parts, shard, b"", b"", b"", b"", _bytes(found))

    def run(batches):
        forget()
        for rows in _grouped(batches):
            yield from one(rows)
        forget()

    return run


def _union(spans: np.ndarray) -> np.ndarray:
    """Overlapping (start, end) joined."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > end[:-1])))
    return np.stack((spans[new, 0], end[np.append(new[1:], len(spans)) - 1]), 1)


# The merge

_SPANS = (("shard", pa.string()), ("spans", pa.binary()))


class _Classes:
    """Distinct contexts of some classes in merged order, until they are compared."""

    def __init__(self, length: int, report):
        self.length, self.report = length, report
        self.clear()

    def clear(self) -> None:
        self.strings: list[bytes] = []
        self.of: list[int] = []
        #: Who waits for the answer: (run, place), or None if the context is known to repeat as a whole.
        self.waits: list[tuple[int, int] | None] = []

    def compare(self) -> None:
        """Reports for each waiting context the bytes from the first to the last window that another one of its class holds."""
        of = np.array(self.of)
        waiting = np.array([w is not None for w in self.waits])
        size = np.bincount(of - of[0])
        asked = np.zeros(len(size), bool)
        asked[(of - of[0])[waiting]] = True
        keep = np.flatnonzero((asked & (size > 1))[of - of[0]])
        if len(keep):
            self._compare([self.strings[i] for i in keep], of[keep], [self.waits[i] for i in keep])
        self.clear()

    def _compare(self, strings: list[bytes], of: np.ndarray, waits: list) -> None:
        length, n = self.length, len(strings)
        back = length - length // 2
        flat = np.frombuffer(b"".join(strings), np.uint8)
        end = np.cumsum([len(s) for s in strings])
        tail = flat[end[:, None] - np.arange(4, 0, -1)].astype(np.int64)
        right, left = tail[:, 0] * 256 + tail[:, 1], tail[:, 2] * 256 + tail[:, 3]
        column = np.arange(length + back + 4)[None, :]
        used = (column < right[:, None]) | ((column >= length) & (column < length + left[:, None])) | (column >= length + back)
        parts = np.zeros((n, length + back + 4), np.uint8)
        parts[used] = flat
        # The anchor of every row at column ``back``.
        rows = np.ascontiguousarray(np.hstack((parts[:, length : length + back][:, ::-1], parts[:, :length])))
        least = length - right  # the windows begin from ``least`` to ``left`` bytes before the anchor
        windows = left - least + 1
        row = np.repeat(np.arange(n), windows)
        before = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(least, windows)
        key = np.empty(len(row), np.uint64)
        wide, bound = rows.shape[1], np.concatenate(([0], np.cumsum(windows)))
        for first in range(0, n, 1000):
            last = min(first + 1000, n)
            s = slice(bound[first], bound[last])
            prefix = prefix_hash(_BYTE[rows[first:last].ravel()])
            start = (row[s] - first) * wide + back - before[s]
            key[s] = span_hash(prefix, start, start + length)
        key = mix(key + mix((of[row].astype(np.uint64) << np.uint64(16)) + before.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        met = np.zeros(len(key), bool)
        met[order[1:]] |= same
        met[order[:-1]] |= same
        waiting = np.array([w is not None for w in waits])
        found = np.flatnonzero(met & waiting[row])
        if not len(found):
            return
        edge = row[found[1:]] != row[found[:-1]]
        outer = np.concatenate((found[np.concatenate(([True], edge))], found[np.concatenate((edge, [True]))]))
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(order))
        at = place[outer]
        partner = np.where(np.concatenate(([False], same))[at], order[at - 1], order[np.minimum(at + 1, len(order) - 1)])
        view = np.lib.stride_tricks.sliding_window_view(rows, length, axis=1)
        equal = np.ones(len(outer), bool)
        for first in range(0, len(outer), 5000):
            s = slice(first, first + 5000)
            a, b = outer[s], partner[s]
            alike = (of[row[a]] == of[row[b]]) & (before[a] == before[b])
            equal[s] = alike & (view[row[a], back - before[a]] == view[row[b], back - before[b]]).all(axis=1)
        half = len(outer) // 2
        for i, (lo, hi, sure) in enumerate(zip(before[outer[:half]].tolist(), before[outer[half:]].tolist(), (equal[:half] & equal[half:]).tolist(), strict=True)):
            r = int(row[outer[i]])
            if not sure:  # unequal strings of one hash
                lo, hi = self._plain(r, rows, of, least, left)
                if hi < lo:
                    continue
            run, p = waits[r]
            self.report(run, p - hi, p - lo + length)

    def _plain(self, r: int, rows: np.ndarray, of: np.ndarray, least: np.ndarray, left: np.ndarray) -> tuple[int, int]:
        """The first and last offset of row r's windows that another row of its class holds, byte by byte."""
        back = rows.shape[1] - self.length
        found = []
        for o in range(int(least[r]), int(left[r]) + 1):
            others = np.flatnonzero((of == of[r]) & (least <= o) & (left >= o) & (np.arange(len(of)) != r))
            if (rows[others, back - o : back - o + self.length] == rows[r, back - o : back - o + self.length]).all(axis=1).any():
                found.append(o)
        return (found[0], found[-1]) if found else (1, 0)


def _rest(row: tuple) -> bytes:
    """What front coding left of a run's slice."""
    n = int(np.frombuffer(row[5], "<u2").sum(dtype=np.int64) - np.frombuffer(row[3], "<u2").sum(dtype=np.int64))
    return pa.decompress(row[4], n, "zstd", asbytes=True)


def _merged(length: int):
    """Merges the runs' slices of each kind and part; (shard, spans of bytes that go)."""
    core, width = length // 2, 2 * length - length // 2 + 4

    def one(slices: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans: dict[int, list[tuple[int, int]]] = {}

        def report(run: int, start: int, end: int) -> None:
            spans.setdefault(run, []).append((start, end))

        last = [b""] * len(slices)

        def taken(k: int, run: Iterator) -> Iterator:
            for string, common in run:
                last[k] = string
                yield string, common

        whole = slices[0][0] == 2
        runs = [taken(k, decode(s[3], _rest(s), width, s[5])) for k, s in enumerate(slices)]
        many = [s[6] for s in slices]
        place = [np.frombuffer(s[7], "<i8").tolist() for s in slices]
        at = [0] * len(slices)
        classes = _Classes(length, report)
        number, string, group, repeats = 0, None, [], False

        def close() -> None:
            """Of equal strings, all that are in several runs or more than once in one repeat as a whole."""
            if string is None:
                return
            if len(group) > 1 or repeats:
                left = 0 if whole else string[-2] * 256 + string[-1]
                right = length if whole else string[-4] * 256 + string[-3]
                for k, p, again in group:
                    if not again:  # the others are known in their shard
                        report(k, p - left, p + right)
                waits = None
            else:
                waits = group[0][:2]
            if not whole:
                classes.strings.append(string)
                classes.of.append(number)
                classes.waits.append(waits)

        for k, common in merge(runs):
            s = last[k]
            again = bool(many[k][at[k]])
            if string is not None and common == len(s) == len(string):
                repeats = repeats or again
            else:
                close()
                if common < core:
                    number += 1
                    if len(classes.strings) >= BATCH:
                        classes.compare()
                string, group, repeats = s, [], again
            group.append((k, place[k][at[k]], again))
            at[k] += 1
        close()
        if classes.strings:
            classes.compare()
        for k, found in spans.items():
            yield _row(_SPANS, slices[k][2], _bytes(_union(np.array(found, np.int64).reshape(-1, 2))))

    def run(batches):
        forget()
        slices: list[tuple] = []
        for rows in _grouped(batches, 1):
            for r in rows:
                if r[0] == 1:
                    yield _row(_SPANS, r[2], r[7])
            for kind in (0, 2):
                slices = [r for r in rows if r[0] == kind]
                if slices:
                    yield from one(slices)
        forget()

    return run


# The whole


def _splitters(ready: DataFrame, shards: int, parts: int, length: int) -> list[bytes]:
    """Bounds of the exchange: quantiles of some anchors' strings of at most about 64 shards, whatever the input's size."""
    core, each = length // 2, max(64, parts)

    def sample(batches):
        forget()
        for (shard, _, path, n, _), *replies in _grouped(batches):
            if n:
                h, place, _, _ = _read_anchors(path, n)
                distinct, one = np.unique(h, return_index=True)
                some = np.sort(one[np.concatenate([np.frombuffer(r[4], np.uint8) for r in replies]) == 1])
                _, data, _ = _read_shard(shard)
                picked = some[np.linspace(0, len(some) - 1, min(each, len(some))).astype(np.int64)] if len(some) else some
                yield pa.RecordBatch.from_pydict({"s": pa.array([data[p : p + core].tobytes() for p in place[picked]], pa.binary())})
        forget()

    step = max(1, shards // 64)
    rows = ready.where(F.pmod(F.xxhash64("shard"), F.lit(step)) == 0).mapInArrow(sample, "s binary").limit(128 * each).collect()
    found = sorted(bytes(r.s) for r in rows)
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest of shards, (shard, spans)): the shards hold ``docs`` with the text as binary in the last column.

    Spans are (start, end) in the shard's bytes, of bytes in repeated strings.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns) if c != text]
    texts = docs.select(*columns, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    manifest = save(texts.mapInArrow(_write_shards(fresh_dir(spark, "shards"), length), _MANIFEST), "shards")
    shards, total = manifest.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(shuffle, total // PART)
    tasks = max(1, min(shards, max(shuffle, shards // 8)))

    hashes = manifest.select("shard", "anchors", "n").repartition(tasks).mapInArrow(_hashes(parts), "part int, shard string, h binary, n binary")
    codes = save(hashes.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_codes(HOT if hot is None else hot), "shard string, part int, codes binary"), "codes")
    nothing = F.lit(None).cast("binary")
    own = manifest.select("shard", F.lit(-1).alias("part"), "anchors", "n", nothing.alias("codes"))
    replies = codes.select("shard", "part", F.lit(None).cast("string").alias("anchors"), F.lit(None).cast("long").alias("n"), "codes")
    ready = own.unionByName(replies).repartition(tasks, "shard").sortWithinPartitions("shard", "part")
    runs = ready.mapInArrow(_sorted_runs(length, _splitters(ready, shards, parts, length), parts), _RUNS)
    merged = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "shard").mapInArrow(_merged(length), "shard string, spans binary")
    return manifest, save(merged, "spans")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, digest: bool = False, hot: int | None = None) -> DataFrame:
    """``docs`` without ``text``, and with n_bytes, n_removed, n_spans and kept (the bytes left; their SHA-256 if ``digest``)."""
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")
    others = besides(docs, new, text)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType() if digest else T.BinaryType())
    schema = T.StructType([*(T.StructField(docs.columns[i], docs.schema[i].dataType) for i in others), *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    manifest, spans = repeats(docs.select(*(F.col(f"`{docs.columns[i]}`") for i in others), F.col(f"`{text}`")), text, length, hot)

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        table, data, bounds = _read_shard(rows[0][0])
        change = np.zeros(len(data) + 1, np.int32)
        for r in rows:
            if r[1] is not None:
                span = np.frombuffer(r[1], "<i8").reshape(-1, 2)
                np.add.at(change, span[:, 0], 1)
                np.add.at(change, span[:, 1], -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = gone[bounds[:-1][bounds[:-1] < len(data)]]
        before, started = (np.concatenate((np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32))) for x in (gone, begins))
        n, removed, count = np.diff(bounds), np.diff(before[bounds]), np.diff(started[bounds])
        for first in range(0, table.num_rows, 1000):
            some = table.slice(first, 1000)
            kept = []
            for i in range(first, first + some.num_rows):
                a, b = bounds[i], bounds[i + 1]
                left = data[a:b] if not removed[i] else data[a:b][~gone[a:b]]
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.tobytes())
            s = slice(first, first + some.num_rows)
            columns = [*(some.column(i).combine_chunks() for i in range(len(others))), *(pa.array(x[s], pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)

    def cut(batches):
        forget()
        for rows in _grouped(batches):
            yield from one(rows)
        forget()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = manifest.select("shard", F.lit(None).cast("binary").alias("spans")).unionByName(spans)
    return met.repartition(max(1, n), "shard").sortWithinPartitions("shard").mapInArrow(cut, schema)


@batched
def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
