"""Suffix arrays by induced sorting, as array operations, and permuted common prefixes.

The buckets of the alphabet are scanned in order as in Nong, Zhang and Chan (2009); everything that one bucket
holds at a time is processed as one array, a few operations for each bucket instead of one for each suffix.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MOST_BUCKETS = 2048


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next one. The last one counts as larger (an end is smallest)."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = -1
    # Equal neighbours take the type of the next different pair.
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _deal(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, the rank of each within its key, and the counts of keys."""
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=width)
    rank = np.arange(len(keys)) - (np.cumsum(counts) - counts)[keys[order]]
    return order, rank, counts


def _induce(s: np.ndarray, is_s: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S-type ones in theirs."""
    n, width = len(s), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    used = np.flatnonzero(sizes)
    order, rank, per = _deal(s[lms], width)
    sa[(ends - per)[s[lms][order]] + rank] = lms[order]
    lms_from = ends - per

    heads = starts.copy()
    # The end of the text induces its last suffix first.
    sa[heads[s[n - 1]]] = n - 1
    heads[s[n - 1]] += 1
    for c in used.tolist():
        done = starts[c]
        while True:
            if done < heads[c]:
                now = sa[done : heads[c]]
                done = heads[c]
            elif done <= starts[c] + sizes[c] and per[c] and done < n + 1:
                now = sa[lms_from[c] : ends[c]]
                done = n + 1
            else:
                break
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                keys = s[before]
                order, rank, got = _deal(keys, width)
                sa[heads[keys[order]] + rank] = before[order]
                heads += got

    tails = ends.copy()
    for c in used[::-1].tolist():
        low = heads[c]  # suffixes of type L lie below
        done = ends[c]
        while True:
            if done > tails[c]:
                now = sa[tails[c] : done][::-1]
                done = tails[c]
            elif done >= 0 and starts[c] < low:
                now = sa[starts[c] : low][::-1]
                done = -1
            else:
                break
            before = now[now > 0] - 1
            before = before[is_s[before]]
            if len(before):
                keys = s[before]
                order, rank, got = _deal(keys, width)
                sa[tails[keys[order]] - 1 - rank] = before[order]
                tails -= got
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, sorting only what is still tied by prefixes of doubled length."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = at
    step = 1
    tied = np.flatnonzero(~first | ~np.append(first[1:], True))  # places in order
    while len(tied):
        suffixes = order[tied]
        beyond = suffixes + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[suffixes]))
        suffixes, second = suffixes[sub], second[sub]
        order[tied] = suffixes
        group = rank[suffixes]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        at = np.maximum.accumulate(np.where(new, tied, 0))
        rank[suffixes] = at
        tied = tied[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


def suffix_array(s: np.ndarray, width: int) -> np.ndarray:
    """Start of every suffix of s (int16 symbols below width) in order; a suffix precedes its extensions."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = _types(s)
    sizes = np.bincount(s, minlength=width)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(lms) < 2:
        return _induce(s, is_s, sizes, lms)
    # Order of the substrings between leftmost S-type places, then their names.
    sa = _induce(s, is_s, sizes, lms)
    leftmost = np.zeros(n, bool)
    leftmost[lms] = True
    ordered = sa[leftmost[sa]]
    ends = np.full(n, n, np.int64)
    ends[lms[:-1]] = lms[1:] + 1
    size = ends[ordered] - ordered
    size[ordered == lms[-1]] = -1  # the last one runs to the end and equals no other
    alike = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0)) + 1  # each compared with the one before it, symbol by symbol
    first = np.cumsum(size[alike]) - size[alike]
    nth = np.arange(int(size[alike].sum())) - np.repeat(first, size[alike])
    agree = s[np.repeat(ordered[alike], size[alike]) + nth] == s[np.repeat(ordered[alike - 1], size[alike]) + nth]
    differs = np.ones(len(ordered), bool)
    if len(alike):
        differs[alike] = ~np.logical_and.reduceat(agree, first)
    names = np.zeros(n, np.int64)
    names[ordered] = np.cumsum(differs) - 1
    by_place = names[lms]
    if (n_names := int(by_place.max()) + 1) < len(lms):
        # The string of names is sorted in turn; a wide alphabet has too many buckets to gain from scanning them.
        ordered = lms[suffix_array(by_place.astype(np.int16), n_names) if n_names <= MOST_BUCKETS else _by_doubling(by_place)]
    return _induce(s, is_s, sizes, ordered.astype(np.int32))


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of s, the length that its suffix shares with the one before it in the suffix array.

    A place whose left neighbours agree shares one less than the place before it (Kaerkkaeinen, Manzini and Puglisi
    2009), so only the others are compared, eight symbols at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([s.astype(np.uint64) + U(1), np.zeros(8, np.uint64)])
    words = np.zeros(n + 1, np.uint64)
    for j in range(4):  # symbols are below 2**16
        words |= padded[j : n + 1 + j] << U(48 - 16 * j)
    place = np.arange(n)
    known = (before > 0) & (place > 0)
    known[known] = s[place[known] - 1] == s[before[known] - 1]
    todo = np.flatnonzero(~known & (before >= 0))
    shared = np.zeros(n, np.int64)
    a, b, own = todo.copy(), before[todo], todo
    while len(own):
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        inside = (a < n) & (b < n)
        whole = (x == 0) & inside
        part = ~whole
        # Leading equal 16-bit symbols of those that end here.
        y = x[part]
        shared[own[part]] += np.where(inside[part], (y < U(1 << 48)).astype(np.int64) + (y < U(1 << 32)) + (y < U(1 << 16)), 0)
        shared[own[whole]] += 4
        own, a, b = own[whole], a[whole] + 4, b[whole] + 4
    # Past either end nothing is shared.
    limit = np.where(before >= 0, n - np.maximum(place, before), 0)
    shared = np.minimum(shared, limit)
    reach = np.where(known, 0, shared + place)
    return np.where(before >= 0, np.maximum.accumulate(reach) - place, 0)
