"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near_duplicates(docs, threshold=0.8, width=5):
    """{index: (least doc_id of the component, links)} of a list of (doc_id, text)."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    return {i: (min(least[root(i)]) if None not in least[root(i)] else None, links[i]) for i in range(len(docs))}


def line_dedup(docs, window=2, mean=3, base=257, modulus=16_777_213):
    """[(doc_id, text, lines removed)] of a list of (doc_id, text), sorted by doc_id."""
    cut = []
    for d, t in docs:
        chunks, now, before = [], [], 0
        lines = [] if t is None else t.split("\n")
        for i, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:6], 16)
            now.append(line)
            if (h + base * before) % modulus % mean == 0 or i + 1 == len(lines):
                chunks.append(now)
                now = []
            before = h
        cut.append((d, t, chunks))
    seen, out = set(), []
    for d, t, chunks in cut:
        left, gone = [], 0
        for c in chunks:
            if len(c) >= 2 and tuple(c) in seen:
                gone += len(c)
            else:
                left.append("\n".join(c))
                seen.add(tuple(c))
        out.append((d, None if t is None else "\n".join(left), gone))
    return out


def contamination(docs, items, window=13):
    """{index: (words, hit, items, digest, contaminated)}."""
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window + 1, 1) if w else 0):
            known[tuple(w[s : s + window])].add(i)
    out = {}
    for k, (_, t) in enumerate(docs):
        w = words(t)
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in known}:
            for s in range(len(w) - size + 1):
                if (own := known.get(tuple(w[s : s + size]))) is not None:
                    found |= own
                    hit[s : s + size] = [1] * size
        ids = sorted(map(str, found))
        out[k] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def repeats(docs, length):
    """[(doc_id, bytes, removed, spans, kept)]."""
    raw = [(t or "").encode() for _, t in docs]
    count = defaultdict(int)
    for b in raw:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def merkle(rows, fanout=16):
    """sorted [(doc_id, leaf, subroot, root, proof, folded root, verified)] of a list of (doc_id, source, lang, n_chars, text)."""
    digest = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(hashes):
        """The root, and of each leaf its siblings, level by level, as pairs of lists."""
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for leaf, node in enumerate(at):
                run = node // fanout * fanout
                paths[leaf].append((hashes[run:node], hashes[node + 1 : run + fanout]))
            hashes = [digest(*hashes[i : i + fanout]) for i in range(0, len(hashes), fanout)]
            at = [n // fanout for n in at]
        return hashes[0], paths

    groups = defaultdict(list)
    for r in rows:
        original = digest(*map(value, r))
        changed = digest(*map(value, (*r[:4], lower(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else original
        groups[b"" if r[1] is None else b"." + r[1].encode()].append((r[0] is not None, r[0] or 0, original, changed, r[0]))
    names = sorted(groups)
    if not names:
        return []
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(names, trees, above, strict=True):
        for (_, _, leaf, changed, d), path in zip(sorted(groups[g]), paths, strict=True):
            folded = changed
            for left, right in path + top:
                folded = digest(*left, folded, *right)
            out.append((d, leaf, subroot, root, digest(*(h for pair in path + top for side in pair for h in side)), folded, folded == root))
    return sorted(out, key=str)
