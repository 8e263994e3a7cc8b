"""Plain models of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, k):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1))


def jaccard_groups(rows, k, percent):
    """Sorted (id, set size, smallest linked id), and the number of links."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, links = {}, 0
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
                links += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), links


def repeats_removed(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def contamination(rows, items, window=10):
    found = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        for i in range(max(len(words) - window, 0) + 1) if words else ():
            found.setdefault(tuple(words[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        words = ALNUM.findall(lower(text))
        hit, ids = set(), set()
        for n in {len(w) for w in found}:
            for k in range(len(words) - n + 1):
                if own := found.get(tuple(words[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((i, len(words), len(hit), sorted(ids)))
    return sorted(out)
