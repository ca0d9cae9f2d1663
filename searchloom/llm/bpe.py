"""Byte-pair encoding of whole texts with the ``tokenizers`` library.

The byte-level pre-tokeniser always ends a piece at certain places, whatever
stands around them: before a lone blank or line feed between two characters that
are no white space, after such a line feed, and between a letter and a mark.  A
text may be cut there and its parts encoded apart.  Parts repeat a lot (they are
words and marks), so each worker keeps a bounded table of their ids, looked up
for a block of texts at once; the library encodes each part the table lacks.

A part of up to 16 bytes is its own key, byte for byte; longer ones are keys of
a dictionary.  Texts with one of the vocabulary's added tokens in them go to the
library whole.
"""

from __future__ import annotations

import ctypes
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textbytes import blocks, mix

#: Bytes of text encoded at once.
BLOCK = 500_000
_WHITE = np.zeros(256, bool)
_WHITE[[32, 10]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[128:] = True
#: First bytes of characters among which there is white space.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*|()\"-/")] = True
#: Second bytes of U+00C0..U+00FF that are letters: all but those of the multiplication and division signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def cuts(b: np.ndarray) -> np.ndarray:
    """For each byte, whether a part may begin there (the first byte's own is not set)."""
    doubt = _DOUBTFUL[b]
    hidden = doubt.copy()
    hidden[1:] |= doubt[:-1]
    hidden[2:] |= doubt[:-2]
    seen = _VISIBLE[b] & ~hidden
    lone = np.zeros(len(b), bool)
    lone[1:-1] = _WHITE[b[1:-1]] & seen[:-2] & seen[2:]
    cut = lone.copy()
    cut[1:] |= lone[:-1] & (b[:-1] == 10)
    letter = _LETTER[b]
    letter[1:] |= _LATIN[b[1:]] & (b[:-1] == 0xC3)
    cut[1:] |= _MARK[b[1:]] & letter[:-1]
    return cut


class Encoder:
    """Encodes blocks of texts to unsigned 32-bit ids."""

    def __init__(self, path: str, entries: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries = entries
        self._forget()

    def _forget(self) -> None:
        n = self.entries
        self._used, self._pool_used = 0, 0
        self._low, self._high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self._size, self._offset, self._count = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self._slots = np.full(4 * n, -1, np.int32)
        self._pool = np.zeros(4 * n, np.uint32)
        self._long: dict[bytes, int] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """New entries, without slots; returns their numbers."""
        n = len(ids)
        count = np.fromiter(map(len, ids), np.int64, n)
        flat = np.fromiter((x for some in ids for x in some), np.uint32, int(count.sum()))
        if self._pool_used + len(flat) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros(max(len(self._pool), len(flat)), np.uint32)))
        new = np.arange(self._used, self._used + n)
        self._low[new], self._high[new], self._size[new], self._count[new] = low, high, size, count
        self._offset[new] = self._pool_used + np.cumsum(count) - count
        self._pool[self._pool_used : self._pool_used + len(flat)] = flat
        self._used += n
        self._pool_used += len(flat)
        return new

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Entries of parts, -1 if missing; ``at``: their first slots."""
        entry = np.full(len(low), -1, np.int64)
        live, mask = np.arange(len(low)), len(self._slots) - 1
        slot = at
        while len(live):
            found = self._slots[slot]
            some = found >= 0
            live, slot, found = live[some], slot[some], found[some]
            same = (self._low[found] == low[live]) & (self._high[found] == high[live]) & (self._size[found] == size[live])
            entry[live[same]] = found[same]
            live, slot = live[~same], (slot[~same] + 1) & mask
        return entry

    def _insert(self, new: np.ndarray, at: np.ndarray) -> None:
        mask, slot = len(self._slots) - 1, at.copy()
        while len(new):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = new[free]  # of several for one slot the last wins
            left = self._slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & mask

    def _entries(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entries of all parts of ``raw`` (8 bytes of padding before and after the texts)."""
        buffer = np.frombuffer(raw, np.uint8)
        eight = np.ndarray(len(buffer) - 7, "<u8", buffer=buffer, strides=(1,))
        size = end - start
        short = np.flatnonzero(size <= 16)
        entry = np.full(len(start), -1, np.int64)
        s, n = start[short], size[short]
        low = eight[s] & _MASK[np.minimum(n, 8)]
        high = np.where(n > 8, eight[end[short] - 8], 0).astype(np.uint64)
        size8 = n.astype(np.uint8)
        at = (mix(low + mix(high + size8.astype(np.uint64))) >> np.uint64(20)).astype(np.int64) & (len(self._slots) - 1)
        got = self._find(low, high, size8, at)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            order = missing[np.lexsort((size8[missing], high[missing], low[missing]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]) | (size8[order[1:]] != size8[order[:-1]])
            new = order[first]
            texts = [raw[a : a + b].decode() for a, b in zip(s[new].tolist(), n[new].tolist(), strict=True)]
            number = self._add(low[new], high[new], size8[new], self._library(texts))
            self._insert(number, at[new])
            got[order] = number[np.cumsum(first) - 1]
        entry[short] = got
        for i in np.flatnonzero(size > 16):
            part = raw[start[i] : end[i]]
            known = self._long.get(part)
            if known is None:
                known = self._long[part] = int(self._add(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint8), self._library([part.decode()]))[0])
            entry[i] = known
        return entry

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the bounds of each text's ids; null counts as empty."""
        ids, counts = [], [np.zeros(1, np.int64)]
        for _, _, raw in blocks(texts, BLOCK):
            own, count = self._encode(raw)
            ids.append(own)
            counts.append(count)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(np.concatenate(counts))

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: self._library([t.decode()])[0] for i, t in enumerate(raw) if any(a in t for a in self.added)}
        if whole:
            raw = [b"" if i in whole else t for i, t in enumerate(raw)]
        joined = b"".join([bytes(8), *raw, bytes(8)])
        size = np.array([len(t) for t in raw], np.int64)
        ends = 8 + np.cumsum(size)
        cut = np.zeros(len(joined), bool)
        cut[8:-8] = cuts(np.frombuffer(joined, np.uint8))[8:-8]
        cut[(ends - size)[size > 0]] = True
        cut[ends[-1]] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], ends[-1])[: len(start)]
        # Parts this block may add, at most: else the table is begun anew.
        if self._used + len(start) > self.entries:
            self._forget()
        if len(start) > self.entries:
            self.entries = 1 << (len(start) - 1).bit_length()
            self._forget()
        entry = self._entries(joined, start, end)
        n = self._count[entry]
        total = np.cumsum(n)
        where = np.repeat(self._offset[entry] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self._pool[where]
        first = np.searchsorted(start, ends - size)
        sums = np.append(0, total)
        count = sums[np.searchsorted(start, ends)] - sums[first]
        if whole:
            at = np.cumsum(count) - count
            parts = [np.array(whole[i], np.uint32) if i in whole else ids[at[i] : at[i] + count[i]] for i in range(len(raw))]
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, count


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


@lru_cache(maxsize=1)
def _libc():
    """The C library, told to give large arrays back to the system when they are freed; None where it has no such calls."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: bytes from which an array is a mapping of its own
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    return libc


def forget() -> None:
    """Gives up the worker's table and what memory it no longer uses: workers outlive tasks, and lie beside each other."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)
