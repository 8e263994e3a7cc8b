"""Periodic runs of words: every stretch that repeats itself at a distance, and the text with the repeats cut.

Method: Baier grouping. Phase one of Baier's suffix sorter refines groups of suffixes from the highest down; when a group is
taken, the length of its common context is the longest Lyndon word that starts at its members, so the Lyndon array falls
out of the grouping itself. It is taken under the order of words and under the reverse order. Each run has such a
Lyndon word as root in one of the two, and longest common extensions of root and copy give the run's two ends.

A run is a stretch of words with smallest period q and a length of at least max(min_length, 2 * q) that no neighbouring word
extends with period q. Words are `[^\\x20\\x09-\\x0D]+`.

Where runs can be at all is found first: of a run of period q all blocks of ceil(min_length / 2) words recur at distance q,
and they cover it. Words outside of recurring blocks (by hash, so rather too many than too few stay) are in no run; the
stretches between them are grouped. Extensions are compared by hashes of two moduli; each run is then compared
word by word, and a text for which one differs is done again with other hashes, so results are exact.

Defined results: a null text has no words, no runs and an empty collapsed text, as has one of white space only; repeated rows
give equal rows; other columns stay as they are, but `n_words`, `runs` and `collapsed` are replaced. Rows are independent:
memory follows the longest text (about 200 bytes a word where all of it recurs), work is linear but for sorting
block hashes and log-many steps of an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two primes below 2**31: products of residues fit into 64 bits.
MODULI = (2147483647, 2147483629)
#: Word positions compared at once when runs are checked, and bytes of text in a batch that is sent back.
CHECK_WORDS, BATCH_BYTES = 1 << 20, 1 << 24

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.BinaryType(), False)]
ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names])


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position; zeros separate strings, and the list begins and ends with one.

    Groups are numbers in a linked list, in suffix order. Every position starts a block: its context. Taking the highest group
    joins each member's block to the block before it, whose start then moves, by how many members it got, to a new group
    right above its old one.
    """
    n, top = len(ranks), max(ranks)
    length, group, before = [1] * n, list(ranks), list(range(-1, n))
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    g = top
    while g > 0:
        got: dict[int, int] = {}
        for i in members[g]:
            if group[i] == g:
                j = before[i]
                whole = length[j] + length[i]
                length[j] = whole
                before[j + whole] = j
                if group[j]:
                    got[j] = got.get(j, 0) + 1
        members[g] = []
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in got.items():
            split.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(split, reverse=True):
            new, upper = len(members), above[old]
            members.append(split[times, old])
            below.append(old)
            above.append(upper)
            above[old] = new
            below[upper] = new
            for j in members[new]:
                group[j] = new
        g = below[g]
    return length


class Extensions:
    """Longest common extensions of two places, for many pairs at once; equal by two hashes."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        self.n, self.tables = len(words), []
        rng = np.random.default_rng(seed)
        for modulus in MODULI:
            powers = np.ones(1, dtype=np.int64)
            factor = int(rng.integers(1 << 20, modulus - 1))
            while len(powers) <= self.n:
                powers = np.concatenate([powers, powers * (int(powers[-1]) * factor % modulus) % modulus])
            sums = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum((words + 1) * powers[: self.n] % modulus, out=sums[1:])
            self.tables.append((modulus, powers, sums % modulus))

    def _equal(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        same = np.ones(len(a), dtype=bool)
        for modulus, powers, sums in self.tables:
            same &= (sums[a + size] - sums[a]) % modulus * powers[b - a] % modulus == (sums[b + size] - sums[b]) % modulus
        return same

    def grow(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on (or up to a and b, exclusive) are equal; a < b."""
        got, step = np.zeros(len(a), dtype=np.int64), 1 << max(self.n.bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(b + got + step <= self.n if forward else a - got - step >= 0)
            x, y = (a[fits] + got[fits], b[fits] + got[fits]) if forward else (a[fits] - got[fits] - step, b[fits] - got[fits] - step)
            got[fits[self._equal(x, y, step)]] += step
            step >>= 1
        return got


def recurring(hashes: np.ndarray, block: int) -> np.ndarray:
    """True for each word inside of a block of words whose hash occurs twice or more."""
    covered = np.zeros(len(hashes), dtype=bool)
    n = len(hashes) - block + 1
    if n < 2:
        return covered
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(block):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    twice = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if len(twice):
        edges = np.zeros(len(hashes) + 1, dtype=np.int64)
        places = np.unique(np.concatenate([order[twice], order[twice + 1]]))
        np.add.at(edges, places, 1)
        np.add.at(edges, places + block, -1)
        covered = np.cumsum(edges[:-1]) > 0
    return covered


def holds(words: np.ndarray, runs: np.ndarray) -> bool:
    """True if in every run (start, length, period) words at that distance are equal."""
    at = 0
    while at < len(runs):
        sizes = runs[at:, 1] - runs[at:, 2]
        some = max(int(np.searchsorted(np.cumsum(sizes), CHECK_WORDS)), 1)
        sizes, part = sizes[:some], runs[at : at + some]
        first = np.repeat(part[:, 0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if (words[first] != words[first + np.repeat(part[:, 2], sizes)]).any():
            return False
        at += some
    return True


def find_runs_of(words: list[bytes], min_length: int) -> np.ndarray:
    """Rows (start, length, period) in this order, by start, then period."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(words) < min_length:
        return none
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    inside = np.flatnonzero(recurring(hashes, -(-min_length // 2)))
    if not len(inside):
        return none
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    numbers: dict[bytes, int] = {}
    ranks, places = [0], [-1]
    for stretch in np.split(inside, breaks):
        if len(stretch) >= min_length:
            ranks += [numbers.setdefault(words[i], len(numbers) + 1) for i in range(stretch[0], stretch[-1] + 1)] + [0]
            places += range(stretch[0], stretch[-1] + 1)
            places.append(-1)
    if len(ranks) == 1:
        return none
    top = len(numbers) + 1
    forward, backward = lyndon_lengths(ranks), lyndon_lengths([top - r if r else 0 for r in ranks])
    text, place = np.array(ranks, dtype=np.int64), np.array(places, dtype=np.int64)
    starts = np.flatnonzero(text)
    gaps, size = np.flatnonzero(text == 0), len(text)
    pairs = np.unique(np.concatenate([starts * size + np.array(x, dtype=np.int64)[starts] for x in (forward, backward)]))
    a, period = pairs // size, pairs % size
    distinct = text.copy()
    distinct[gaps] = top + np.arange(len(gaps))  # no two separators are equal, so nothing extends over one
    seed = 1
    while True:
        reach = Extensions(distinct, seed)
        left, right = reach.grow(a, a + period, False), reach.grow(a, a + period, True)
        found = (left + right >= period) & (left + right + period >= min_length)
        _, once = np.unique(((a - left) * size + period)[found], return_index=True)
        runs = np.stack([a - left, left + right + period, period], 1)[found][once]
        if holds(distinct, runs):
            break
        seed += 1
    runs[:, 0] = place[runs[:, 0]]
    return runs


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that some run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


def find_runs(docs: DataFrame, min_length: int = 12, text_col: str = "text") -> DataFrame:
    """Adds `n_words`, `runs` (array of start, length, period, by start, then period) and `collapsed` in place of the text."""
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    dropped = {text_col, *(f.name for f in ADDED)}
    kept = [c for c in docs.columns if c not in dropped]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("binary").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                counts, runs, texts, size, first = [], [], [], 0, at
                while at < batch.num_rows and size < BATCH_BYTES:
                    words = (batch.column(len(kept))[at].as_py() or b"").split()
                    rows = find_runs_of(words, min_length)
                    counts.append(len(words))
                    runs.append([dict(zip(RUN.names, r)) for r in rows.tolist()])
                    texts.append(collapse(words, rows))
                    size += len(texts[-1])
                    at += 1
                part = batch.slice(first, at - first)
                arrays = [part.column(k) for k in range(len(kept))]
                arrays += [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.field("element", ARROW_RUN, False))), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *(f.name for f in ADDED)])

    out = T.StructType([*(source.schema[c] for c in kept), *ADDED])
    return source.mapInArrow(work, out).withColumn("collapsed", F.col("collapsed").cast("string"))
