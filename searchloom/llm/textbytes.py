"""Words and hashes of many texts at once, with numpy on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes (a longer text is a block).
BLOCK = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes after lower-casing: 0-9, a-z and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's end)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _P), np.full(size, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base modulo 2**64, and of its inverse."""
    up, down = _powers(1 << max(20, (max(n, 2) - 1).bit_length()))
    return up[:n], down[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i..j) times powers of the base."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of values[start..end), from ``prefix_hash``."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def few_at_a_time(column: pa.Array | list, rows: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow column, of which only some are Python strings at a time."""
    if isinstance(column, list):
        yield from column
        return
    for first in range(0, len(column), rows):
        yield from column.slice(first, rows).to_pylist()


def blocks(texts: pa.Array | list, size: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, their UTF-8 texts) for runs of rows of about ``size`` bytes."""
    first, total, some = 0, 0, []
    for i, text in enumerate(few_at_a_time(texts)):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if some and total + len(raw) > size:
            yield first, i, some
            first, total, some = i, 0, []
        some.append(raw)
        total += len(raw) + 1
    if some:
        yield first, first + len(some), some


class Words:
    """The words of a block of texts: runs of ``[0-9a-z]`` and non-ASCII bytes.

    ``start``/``end`` are byte positions in ``raw`` (the lower-cased texts, a
    line feed after each), ``doc`` the row of each word, ``hash`` its 64-bit
    hash and ``bounds`` the first word of each row (with an end).
    """

    def __init__(self, texts: list[bytes]):
        self.raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.doc_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[1:] = _WORD[self.raw]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = span_hash(prefix_hash(_BYTE[self.raw]), self.start, self.end)
        self.bounds = np.concatenate(([0], np.searchsorted(self.start, self.doc_ends)))
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each distinct run of ``width`` words of each row, in row order.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(words.hash)
    starts = np.arange(n)
    last = words.bounds[1:][words.doc]
    keep = (starts + width <= last) | (starts == words.bounds[:-1][words.doc])
    starts = starts[keep]
    doc = words.doc[starts]
    hashes = span_hash(prefix, starts, np.minimum(starts + width, last[keep]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]
