"""Vectorised word and shingle hashes over Arrow text columns.

A text is looked at as UTF-8 bytes. Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.
Work goes piece by piece: whole rows up to about a megabyte at a time, so memory depends on the longest text
only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = PIECE_BYTES
    while size < n:
        size *= 2
    return _powers(size)


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) for consecutive whole rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + piece_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and for each row the index of its first word (one more entry at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[buf]
    inside = ~space
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    rows = offsets[:-1][full]
    begin[rows] = inside[rows]
    rows = offsets[1:][full] - 1
    end[rows] = inside[rows]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_chunks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as 64-bit chunks of up to eight bytes, A-Z as a-z: (chunk, its number in the word, first chunk of each word)."""
    padded = np.concatenate([FOLD[buf], np.zeros(8, np.uint8)])
    from_each = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    length = ends - starts
    per_word = (length + 7) // 8
    first = np.cumsum(per_word) - per_word
    word = np.repeat(np.arange(len(starts)), per_word)
    nth = np.arange(len(word)) - first[word]
    beyond = U(8) * np.maximum(8 - length[word] + 8 * nth, 0).astype(np.uint64)
    return (from_each[starts[word] + 8 * nth] << beyond) >> beyond, nth, first


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z. Every eight bytes are scrambled, by their place, before they are added."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    chunks, nth, first = word_chunks(buf, starts, ends)
    parts = mix(mix(chunks) + nth.astype(np.uint64) * U(_BASE))
    return mix(np.add.reduceat(parts, first) + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def tells_words_apart(hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
    """True if words of these texts with equal hashes have equal bytes (A-Z as a-z)."""
    if not len(starts):
        return True
    chunks, nth, first = word_chunks(buf, starts, ends)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = one[which]
    length = ends - starts
    if not (length[same] == length).all():
        return False
    word = np.repeat(np.arange(len(starts)), (length + 7) // 8)
    return bool((chunks[first[same][word] + nth] == chunks).all())


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their bounds. Fewer words than k make one shingle."""
    n_words = np.diff(bounds)
    n_out = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n_out)])
    total = int(out_bounds[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_bounds
    row = np.repeat(np.arange(len(n_words)), n_out)
    at = bounds[:-1][row] + np.arange(total) - out_bounds[:-1][row]
    left = np.minimum(n_words[row], k)
    out = left.astype(np.uint64) * U(0xA0761D6478BD642F)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        part = mix(padded[at + j] + U((0xE7037ED1A0B428DB * (2 * j + 1)) & _MASK))
        out = out + np.where(left > j, part, U(0))
    return mix(out), out_bounds


def tells_shingles_apart(shingles: np.ndarray, out_bounds: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, k: int) -> bool:
    """True if shingles (as `shingle_hashes` gives them) with equal hashes have equal words."""
    if not len(shingles):
        return True
    n_words, n_out = np.diff(bounds), np.diff(out_bounds)
    row = np.repeat(np.arange(len(n_words)), n_out)
    at = bounds[:-1][row] + np.arange(len(shingles)) - out_bounds[:-1][row]
    left = np.minimum(n_words[row], k)
    order = np.argsort(shingles)
    x = order[:-1][shingles[order[1:]] == shingles[order[:-1]]]
    y = order[1:][shingles[order[1:]] == shingles[order[:-1]]]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    same = left[x] == left[y]
    for j in range(k):
        same &= (padded[at[x] + j] == padded[at[y] + j]) | (left[x] <= j)
    return bool(same.all())


def distinct_in_rows(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each row's hashes and drop repeats."""
    hashes = hashes.copy()
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            hashes[s:e].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], counts[bounds]
