"""Front-coded sorted runs of byte strings, and their merge by a loser tree.

A run stores of every string only what follows its common prefix with the one
before.  The merge keeps, for every loser in the tree, the length of its common
prefix with the string that beat it; two candidates are told apart by these
lengths alone wherever they differ, and otherwise compared from there on, so no
known prefix is compared again.  Of a string and a longer one that begins with
it, the shorter comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sort_order(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of (n, width) bytes of which each row's first ``lengths`` count; what follows is 0."""
    by_length = np.argsort(lengths, kind="stable")
    return by_length[np.argsort(strings[by_length].view(f"S{strings.shape[1]}").ravel(), kind="stable")]


def front_code(strings: np.ndarray, lengths: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """(common prefixes with the string before, two bytes each; the rests) of sorted (n, width) bytes, ``lengths`` of each (all, by default)."""
    n, width = strings.shape
    lengths = np.full(n, width) if lengths is None else lengths
    common = np.zeros(n, np.uint16)
    if n > 1:
        differs = strings[1:] != strings[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        common[1:] = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))
    column = np.arange(width)[None, :]
    rest = strings[(column >= common[:, None]) & (column < lengths[:, None])]
    return common.astype("<u2").tobytes(), rest.tobytes()


def decode(common: bytes, rest: bytes, width: int, lengths: bytes | None = None) -> Iterator[tuple[bytes, int]]:
    """(string, common prefix with the one before) of a front-coded run; ``lengths`` (two bytes each) where they aren't all ``width``."""
    last, at = b"", 0
    known = np.frombuffer(common, "<u2").tolist()
    sizes = [width] * len(known) if lengths is None else np.frombuffer(lengths, "<u2").tolist()
    for n, size in zip(known, sizes, strict=True):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        yield last, n


def _mismatch(a: bytes, b: bytes, start: int) -> int:
    """The first place from ``start`` on where a and b differ, or the shorter one's length."""
    n = min(len(a), len(b))
    while start < n and a[start : start + 16] == b[start : start + 16]:
        start += 16
    while start < n and a[start] == b[start]:
        start += 1
    return min(start, n)


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the string put out before) in the order of all strings.

    A run's i-th appearance stands for its i-th string, which is the last that was taken from it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [None] * k
    for i, run in enumerate(runs):
        head[i] = next(run, (None, 0))[0]
    common = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        m = _mismatch(x, y, common[a])
        a, b = (a, b) if m == len(x) or (m < len(y) and x[m] < y[m]) else (b, a)
        common[b] = m
        return a, b

    # Losers of a bottom-up tournament; all common prefixes are with the empty string at first.
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    best = winner[1]
    while head[best] is not None:
        yield best, common[best]
        head[best], common[best] = next(runs[best], (None, 0))
        node = (best + k) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2
