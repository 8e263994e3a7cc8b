r"""N-gram Jaccard self-join by universe partition and pigeonhole.

The set of a document holds its distinct k-word shingles. Two sets with Jaccard similarity of at least p
percent differ in few shingles, d <= |R| (100 - p) / p. Shingles are hashed into segments; if the segments'
budgets add up to more than d, some segment of the two sets differs by no more than its budget less one.

* Sizes fall into bands, each with its own number of segments. A set is indexed in its own band and in the
  next one if a partner may be there, so both sets of a pair always meet in the larger one's band.
* A segment has budget 1 (equal subsets are looked up), or budget 2 (subsets that differ by one shingle are
  found too: the subset and each of its one-deletion neighbours are indexed), or budget 0 (passed over).
* How many segments of a band have budget 2 follows from a cost model over the number of documents in each
  band, counted over all documents. Budget 0 goes, document by document, to segments of few shingles (of none, where
  segments are small), which many documents share; the set then goes on to further segments until its budgets suffice.
  Both rules are sound: equal segments have equal sizes, and a set uses its segments in one fixed order.
* A bucket's members are compared with one of them, its head, only. Any two of them that are not yet in one component
  may still be linked; `_across` finds those with prefix filters on how they differ from the centre of the head's members.
  So a group of near copies is joined without comparing all its pairs, and yet no link is lost.
* Every comparison that counts is exact: both whole texts are cut into shingles again and intersected by 64-bit
  hashes; where these do not tell apart all words and shingles of the texts at hand, byte by byte, the words
  themselves are compared.

Defined results: null texts, and texts without words, have the empty set and no links; a text of fewer than
k words is one shingle; equal texts are one node; rows that share an id are all kept, each with its text's
component; a null id never names a component that has other ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import textbytes as tb
from foliomill.llm.common import dropped, exploded, lower_ascii, saved, saved_by, scratch_dir
from foliomill.llm.graph import connected_components

BAND_RATIO = 1.5
#: Heads with more members are replaced by the centre of about so many of them.
LARGE, SAMPLED = 64, 24
#: Index entries are met in so many shares by signature, one after another, each in tasks of about so many entries. Heads with their members are taken
#: in rounds of about so many pairs, or entries, for each document. So what lies in shuffle files at once grows with the documents only.
SHARES, ENTRIES_PER_TASK = 2, 1 << 20
PAIRS_PER_ROUND, ENTRIES_PER_ROUND = 0.5, 24
#: 64-bit words of a set's sketch.
SKETCH = 4
#: Heads with more members than this are cut into about the root of (members / this) lots by shingle: both the copies of a member and the share of a task then grow with that root.
LOT = 64
#: Nodes are known by 47 bits of their MD5 in index entries; above these, a mark that a shingle is gone. Of signatures 48 bits are kept, besides those that deal them out.
GONE = 1 << 47
U = np.uint64


@dataclass(frozen=True)
class Scheme:
    """How the sets of a size band are indexed."""

    band: int
    low: int
    high: int
    segments: int
    double: int  # so many segments, the first ones, have budget 2
    least: int  # segments of fewer shingles have budget 0


def band_limits(largest: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high))
        low = high + 1
    return out


def allowed(size: int | np.ndarray, percent: int):
    """Most shingles in which a set of that size can differ from a partner."""
    return size * (100 - percent) // percent


@lru_cache(maxsize=4096)
def scheme_for(band: int, low: int, high: int, docs: int, percent: int) -> Scheme:
    """The cheapest allocation: index entries, plus chance agreements that would have to be compared.

    Two sets agree by chance in a segment about as often as both have next to nothing in it.
    """
    need = allowed(high, percent) + 1
    typical = (low + high) / 2
    best = None
    for double in range(min(4, (need + 1) // 2) + 1):
        base = double + max(need - 2 * double, 0)
        if base == 0:
            continue
        least = 3 if low / base >= 5 else 2 if low / base >= 4 else 1
        # Enough segments even where the smallest sets of the band leave some of them nearly empty.
        few = sum(math.exp(-low / base) * (low / base) ** i / math.factorial(i) for i in range(least))
        segments = base + (math.ceil(1.5 * few * base) + 2 if base > 8 else 0)
        tokens = typical / segments
        entries = segments + double * tokens
        chance = docs * math.exp(-2 * 0.95 * tokens) * (segments if base <= 8 else 0.05 * segments)
        cost = entries + 20 * chance
        if best is None or cost < best[0]:
            best = (cost, Scheme(band, low, high, segments, double, least))
    return best[1]


def _node_and_shingles(buf: np.ndarray, offsets: np.ndarray, k: int):
    starts, ends, bounds = tb.words(buf, offsets)
    return tb.distinct_in_rows(*tb.shingle_hashes(tb.word_hashes(buf, starts, ends), bounds, k))


def _nodes(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    folded = tb.FOLD[buf].tobytes()
    return [hashlib.md5(folded[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _entries(tokens: np.ndarray, bounds: np.ndarray, rows: np.ndarray, schemes: list[Scheme], which: np.ndarray, percent: int):
    """Index entries of some rows, each with one scheme: (row, signature) of subsets and of one-deletions."""
    sizes = np.diff(bounds)[rows]
    segs = np.array([s.segments for s in schemes])[which]
    doubles = np.array([s.double for s in schemes])[which]
    leasts = np.array([s.least for s in schemes])[which]
    bands = np.array([s.band for s in schemes], np.uint64)[which]
    job = np.repeat(np.arange(len(rows)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    tok = tokens[bounds[:-1][rows][job] + np.arange(first[-1]) - first[:-1][job]]
    salted = tb.mix(tok + bands[job] * U(0x9E3779B97F4A7C15))
    base = np.concatenate([[0], np.cumsum(segs)])
    seg = base[:-1][job] + (salted % segs[job].astype(np.uint64)).astype(np.int64)
    member = tb.mix(salted)
    total = int(base[-1])
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, seg, member)
    counts = np.bincount(seg, minlength=total)
    owner = np.repeat(np.arange(len(rows)), segs)
    place = np.arange(total) - base[:-1][owner]
    budget = np.where(place < doubles[owner], 2, 1)
    # A neighbour of one shingle fewer must still be indexed by its own set.
    least = leasts[owner]
    used = budget * (counts >= least + (budget == 2))
    running = np.cumsum(used)
    running -= np.concatenate([[0], running])[base[:-1][owner]]
    need = allowed(sizes, percent)[owner] + 1
    short = (running[base[1:] - 1] < allowed(sizes, percent) + 1)[owner]
    emit = short | ((running - used < need) & (counts >= least))
    label = tb.mix(place.astype(np.uint64) + bands[owner] * U(0x100000001B3))
    exact = np.flatnonzero(emit)
    gone = np.flatnonzero((emit & (budget == 2))[seg])
    return rows[owner[exact]], tb.mix(sums[exact] ^ label[exact]), rows[job[gone]], tb.mix((sums[seg[gone]] - member[gone]) ^ label[seg[gone]])


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[order].view(np.int64)))


def _sizes(k: int):
    """Batches of (id, text) to (id, n_shingles, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in tb.pieces(batch.column(1)):
                _, bounds = _node_and_shingles(buf, offsets, k)
                columns = [batch.column(0).slice(first, len(offsets) - 1), pa.array(np.diff(bounds), pa.int64()), pa.array(_nodes(buf, offsets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "node"])

    return run


_LIMITS = band_limits(1 << 40)
_HIGHS = np.array([h for _, h in _LIMITS])


def _bands_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(_HIGHS, sizes)


def _index(k: int, percent: int, docs_in_band: dict[int, int]):
    """Batches of texts to index entries (node, exact, gone). A node's second copy in a task has none."""

    def scheme(band: int) -> Scheme:
        return scheme_for(band, *_LIMITS[band], docs_in_band.get(band, 1), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, buf, offsets in tb.pieces(batch.column(0)):
                n_rows = len(offsets) - 1
                tokens, bounds = _node_and_shingles(buf, offsets, k)
                sizes, nodes = np.diff(bounds), _nodes(buf, offsets)
                fresh = np.zeros(n_rows, bool)
                for i, node in enumerate(nodes):
                    if sizes[i] and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                rows = np.flatnonzero(fresh)
                parts = []
                if len(rows):
                    own = _bands_of(sizes[rows])
                    beyond = sizes[rows] * 100 // percent > _HIGHS[own]
                    for some, bands in ((rows, own), (rows[beyond], own[beyond] + 1)):
                        if len(some):
                            found, which = np.unique(bands, return_inverse=True)
                            parts.append(_entries(tokens, bounds, some, [scheme(int(b)) for b in found], which, percent))
                none = (np.zeros(0, np.int64), np.zeros(0, np.uint64)) * 2
                exact_row, exact, gone_row, gone = (np.concatenate(x) for x in zip(none, *parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), _lists(exact_row, exact, n_rows), _lists(gone_row, gone, n_rows)], names=["node", "exact", "gone"])

    return run


def _six(x: np.ndarray) -> bytes:
    """The lower 48 bits of each number."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(x: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(x), np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return out.view("<u8").ravel()


def _dealt(index, share: int, tasks: int):
    """Batches of texts to one share of their index entries, packed: (task, signatures, codes). An entry takes 12 bytes, less once compressed."""

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        signatures, codes = (np.concatenate(x) for x in zip(*found, strict=True))
        place = (signatures // U(SHARES) % U(tasks)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(tasks + 1))
        signatures, codes = _six(signatures[order] >> U(16)), _six(codes[order])
        some = np.flatnonzero(np.diff(bounds))
        cut = lambda x: pa.array([x[6 * bounds[t] : 6 * bounds[t + 1]] for t in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(signatures), cut(codes)], names=["task", "signatures", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in index(batches):
            nodes = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8")[::2].astype(np.uint64) >> U(17)
            for column, mark in ((batch.column(1), 0), (batch.column(2), GONE)):
                signatures = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                codes = np.repeat(nodes, column.value_lengths().to_numpy(zero_copy_only=False)) + U(mark)
                own = signatures % U(SHARES) == share
                found.append((signatures[own], codes[own]))
                held += len(found[-1][0])
            if held > 2 * ENTRIES_PER_TASK:
                yield packed(found)
                found, held = [], 0
        if held:
            yield packed(found)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed entries of a task to distinct pairs (code_a, code_b): the head of a signature, its smallest whole entry, with each other member."""
    signatures, codes = [], []
    for batch in batches:
        signatures += batch.column(0).to_pylist()
        codes += batch.column(1).to_pylist()
    if not signatures:
        return
    signatures, codes = _from_six(signatures), _from_six(codes)
    order = np.argsort(signatures, kind="stable")
    same = signatures[order][1:] == signatures[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # most signatures occur once
    order = order[np.lexsort((codes[order], signatures[order]))]
    signatures, codes = signatures[order], codes[order]
    first = np.concatenate([np.ones(min(len(order), 1), bool), signatures[1:] != signatures[:-1]])
    heads = codes[np.flatnonzero(first)][np.cumsum(first) - 1]
    members = codes & U(GONE - 1)
    some = (heads < GONE) & (heads != members)
    heads, members = heads[some], members[some]
    order = np.lexsort((members, heads))
    heads, members = heads[order], members[order]
    new = np.concatenate([np.ones(min(len(order), 1), bool), (heads[1:] != heads[:-1]) | (members[1:] != members[:-1])])
    yield pa.RecordBatch.from_arrays([pa.array(heads[new].view(np.int64)), pa.array(members[new].view(np.int64))], names=["code_a", "code_b"])


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _exact_counts(a: str | None, b: str | None, k: int) -> tuple[int, int, int]:
    def shingles(text: str | None) -> set[tuple[bytes, ...]]:
        words = (text or "").encode().translate(tb.FOLD.tobytes()).split()
        return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()

    a_set, b_set = shingles(a), shingles(b)
    return len(a_set & b_set), len(a_set), len(b_set)


def _pairs_of_sets(texts_a: pa.Array, texts_b: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """(first pair, sets of a and b by turns, whether their hashes tell all words and shingles apart) for some pairs at a time."""
    texts_a, texts_b = _unpacked(texts_a), _unpacked(texts_b)
    bytes_of = lambda x: pc.fill_null(pc.binary_length(x), 0).to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(bytes_of(texts_a) + bytes_of(texts_b))])
    first, n = 0, len(texts_a)
    while first < n:
        last = int(np.searchsorted(upto, upto[first] + 2 * tb.PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        both = pa.concat_arrays([texts_a.slice(first, last - first), texts_b.slice(first, last - first)])
        turns = np.arange(2 * (last - first)).reshape(2, -1).T.ravel()
        ((_, buf, offsets),) = tb.pieces(both.take(pa.array(turns)), int(upto[last] - upto[first]) + 1)
        starts, ends, bounds = tb.words(buf, offsets)
        words = tb.word_hashes(buf, starts, ends)
        shingles, marks = tb.shingle_hashes(words, bounds, k)
        apart = tb.tells_words_apart(words, buf, starts, ends) and tb.tells_shingles_apart(shingles, marks, words, bounds, k)
        tokens, marks = tb.distinct_in_rows(shingles, marks)
        yield first, [tokens[s:e] for s, e in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)], apart
        first = last


def _differences(k: int):
    """Batches of (head, text of the head, text of a member) to (head, added, lost): shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets, _ in _pairs_of_sets(batch.column(1), batch.column(2), k):
                pairs = list(zip(sets[::2], sets[1::2], strict=True))
                lists = lambda found: pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
                added, lost = lists(b[~_is_in(b, a)] for a, b in pairs), lists(a[~_is_in(a, b)] for a, b in pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(pairs)), added, lost], names=["head", "added", "lost"])

    return run


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, the parity of how many of its shingles fall on each bit. Two sketches differ in no more bits than the sets in shingles."""
    bits, owner = 64 * SKETCH, np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = (tb.mix(np.concatenate([np.zeros(0, np.uint64), *sets])) % U(bits)).astype(np.int64)
    odd = np.bincount(owner * bits + at, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), SKETCH)


@dataclass(frozen=True)
class _Apart:
    """How a member differs from the centre c of its head's members: what it adds, what it lacks, and the prefixes to index."""

    adds: int
    lacks: int
    near: bool
    added: np.ndarray
    lacked: np.ndarray
    far: np.ndarray


def _apart(head: np.ndarray, member: np.ndarray, gain: np.ndarray, drop: np.ndarray, common: np.ndarray, percent: int) -> _Apart:
    beta, size = 100 - percent, len(member)
    inside = _is_in(member, head)
    only_head = head[~_is_in(head, member)]
    if len(drop):
        inside &= ~_is_in(member, drop)
        only_head = only_head[~_is_in(only_head, drop)]
    if len(gain):
        inside |= _is_in(member, gain)
        only_head = np.concatenate([only_head, gain[~_is_in(gain, member)]])

    def rare_first(x: np.ndarray) -> np.ndarray:
        popular = _is_in(x, common)
        return np.concatenate([np.sort(x[~popular]), np.sort(x[popular])])

    adds, lacks = size - int(inside.sum()), len(only_head)
    union = adds + len(head) + len(gain) - len(drop)
    room = allowed(size, percent)
    none = member[:0]
    near, far = 100 * (adds + lacks) <= 3 * beta * union, 100 * (adds + lacks) > 2 * beta * union
    added = rare_first(member[~inside]) if adds else none
    lacked = rare_first(only_head)[: max(room - adds + 1, 0)] if near and lacks else none
    whole = np.concatenate([added, member[inside]])[: size - -(-percent * size // 100) + 1] if far else none
    return _Apart(adds, lacks, near, added[: room + 1] if near else none, lacked, whole)


_SKETCHES = [f"sketch_{i}" for i in range(SKETCH)]


def _overlaps(k: int, percent: int, prefixes: bool):
    """Batches of (a, b, text_a, text_b) to (a, b, shared, size_a, size_b). With prefixes, the batches also hold the centre
    of the head a by (gain, drop, common), and what `_across` explains follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets, apart in _pairs_of_sets(batch.column(2), batch.column(3), k):
                n = len(sets) // 2
                part = batch.slice(first, n)
                counts = [(int(_is_in(b, a).sum()), len(a), len(b)) for a, b in zip(sets[::2], sets[1::2], strict=True)]
                if not apart:
                    counts = [_exact_counts(a.as_py(), b.as_py(), k) for a, b in zip(_unpacked(part.column(2)), _unpacked(part.column(3)), strict=True)]
                columns = [part.column(0), part.column(1), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(3))]
                names = ["a", "b", "shared", "size_a", "size_b"]
                if prefixes:
                    token = lambda x: np.sort(np.array(x.as_py() or [], np.int64).view(np.uint64))
                    centres = [[token(part.column(j)[i]) for j in (4, 5, 6)] for i in range(n)]
                    found = [_apart(sets[2 * i], sets[2 * i + 1], *centres[i], percent) for i in range(n)]
                    short = lambda x: x.astype(np.uint32).view(np.int32)  # noqa: E731  equal shingles stay equal
                    columns += [pa.array([f.adds for f in found], pa.int32()), pa.array([f.lacks for f in found], pa.int32()), pa.array([f.near for f in found], pa.bool_())]
                    columns += [pa.array([short(x) for x in xs], pa.list_(pa.int32())) for xs in ([f.added for f in found], [f.lacked for f in found], [f.far for f in found])]
                    columns += [pa.array(x) for x in _sketches(sets[1::2]).T.copy()]
                    names += ["adds", "lacks", "near", "added", "lacked", "far", *_SKETCHES]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed one by one: they are shuffled several times."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        bodies = pa.array([press.compress((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), bodies], names=["node", "text"])


def _unpacked(bodies: pa.Array) -> pa.Array:
    if not pa.types.is_binary(bodies.type) and not pa.types.is_large_binary(bodies.type):
        return bodies
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x.as_py()).decode() for x in bodies], pa.large_string())


def _node(text: Column) -> Column:
    return F.unhex(F.md5(lower_ascii(F.coalesce(text, F.lit("")))))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds text_a and text_b to pairs (a, b); rows end up where their a is."""
    for side in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int, centres: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes with the sizes of their sets and of the intersection; with centres, what `_across` needs too."""
    more, columns = "", ["a", "b", "text_a", "text_b"]
    pairs = _with_texts(pairs, texts)
    if centres is not None:
        pairs = pairs.join(centres.withColumnRenamed("head", "a"), "a", "left")
        more, columns = ", adds int, lacks int, near boolean, added array<int>, lacked array<int>, far array<int>" + "".join(f", {c} long" for c in _SKETCHES), [*columns, "gain", "drop", "common"]
    return pairs.select(columns).mapInArrow(_overlaps(k, percent, centres is not None), f"a binary, b binary, shared long, size_a long, size_b long{more}")


def _centres(pairs: DataFrame, texts: DataFrame, k: int, large: int) -> DataFrame:
    """Of each head with more than `large` members: `gain` and `drop`, shingles to add to the head's and to take from them so
    that the centre has what most members have, and `common`, others that an eighth of the members add or lack.

    Both come from about `SAMPLED` members by hash. They decide only what is compared with what, not what is linked: any
    centre gives the same links. Lists are bounded by eight times the mean set of a head's members.
    """
    per_head = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > large)
    some = pairs.join(per_head, "a").where(F.pmod(F.xxhash64("b"), F.col("members")) < SAMPLED).select("a", "b")
    found = _with_texts(some, texts).select("a", "text_a", "text_b").mapInArrow(_differences(k), "head binary, added array<long>, lost array<long>")
    flat = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))
    counted = found.select("head", F.inline(F.concat(flat("added"), flat("lost")))).groupBy("head", "kind", "token").agg(F.count(F.lit(1)).alias("n"))
    sampled = some.groupBy(F.col("a").alias("head")).agg(F.count(F.lit(1)).alias("sampled"))
    often = counted.where("n > 2").join(sampled, "head").where("8 * n >= sampled")
    most = F.col("n") * 2 > F.col("sampled") + 1  # the head counts too
    lists = {"gain": most & (F.col("kind") == "added"), "drop": most & (F.col("kind") == "lost"), "common": ~most}
    return often.groupBy("head").agg(*[F.collect_list(F.when(test, F.col("token"))).alias(name) for name, test in lists.items()])


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(f"100 * shared >= {percent} * (size_a + size_b - shared)").select("a", "b")


def similar_groups(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text: str = "text", folder: str | None = None, large: int = LARGE) -> DataFrame:
    """One row for each document: `id_col`, `n_shingles` (long) and `component_id` (smallest id reachable by links).

    Heads of more than `large` members are replaced by centres, which changes the work, not the links.

    Writes intermediate tables to `folder` (by default a new one in the cluster's checkpoint folder).
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, node binary"
    slim = saved(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_sizes(k), schema), folder, "slim")
    band = F.size(F.filter(F.array(*[F.lit(h).cast("long") for h in _HIGHS.tolist()]), lambda h: h < F.col("n_shingles")))
    in_band = {r["band"]: r["docs"] for r in slim.where("n_shingles > 0").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("docs")).collect()}  # a few dozen bands

    # Entries are made anew for each share and carry their node's hash only. Nodes of equal hashes would only make more pairs to compare.
    code = F.shiftrightunsigned(F.conv(F.hex(F.substring("node", 1, 6)), 16, 10).cast("long"), 1)
    tasks = max(1, math.ceil(_expected_entries(in_band, percent) / SHARES / ENTRIES_PER_TASK))

    def met_in(share: int) -> DataFrame:
        dealt = docs.select(F.col(text).alias("text")).mapInArrow(_dealt(_index(k, percent, in_band), share, tasks), "task int, signatures binary, codes binary")
        return dealt.repartitionById(tasks, F.col("task")).select("signatures", "codes").mapInArrow(_met, "code_a long, code_b long")

    met = reduce(DataFrame.union, [saved(met_in(i), folder, f"met-{i}") for i in range(SHARES)]).distinct()
    named = slim.where("n_shingles > 0").select("node", code.alias("code")).distinct()
    for side in ("a", "b"):
        met = met.join(named.select(F.col("node").alias(side), F.col("code").alias(f"code_{side}")), f"code_{side}")
    pairs = saved(met.select("a", "b"), folder, "pairs")

    # Texts of all nodes that share a bucket with another one, once each.
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    packed = docs.select(_node(F.col(text)).alias("node"), F.col(text).alias("text")).mapInArrow(_pack, "node binary, text binary")
    once = packed.groupBy("node").agg(F.first("text").alias("text"))
    texts = saved_by(once.join(touched, "node", "left_semi"), folder, "texts", "node")

    centres = saved(_centres(pairs, texts, k, large), folder, "centres")
    n_docs = sum(in_band.values())
    rounds = max(1, math.ceil(pairs.count() / (PAIRS_PER_ROUND * max(n_docs, 1))))
    compared = _in_rounds(lambda some: _compared(pairs.where(some), texts, k, percent, centres), "a", rounds, folder, "compared")
    links = saved(_links(compared, percent), folder, "links-1")
    parts = connected_components(links, folder, "parts-1")
    apart = saved(_members_apart(compared, parts, percent), folder, "apart")
    entries = apart.agg(F.sum("entries")).first()[0] or 0
    more_pairs = saved(_across(compared, apart, touched, percent, max(1, math.ceil(entries / (ENTRIES_PER_ROUND * max(n_docs, 1)))), folder), folder, "pairs-2")
    for name in ("apart", *(f"compared-{r}" for r in range(rounds))):
        dropped(spark, folder, name)
    more_links = saved(_links(_compared(more_pairs, texts, k, percent), percent), folder, "links-2")
    if not more_links.isEmpty():
        parts = connected_components(links.union(more_links), folder, "parts-2")
    dropped(spark, folder, "texts")

    # Ids: the smallest of each node, then of each component.
    of_node = slim.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least_id"))
    rooted = of_node.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least_id")
    of_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(of_root, "root").select("node", "component_id")
    return (
        slim.where("n_shingles > 0").join(named, "node").select(F.col("id").alias(id_col), "n_shingles", "component_id").union(slim.where("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id")))
    )


def _expected_entries(in_band: dict[int, int], percent: int) -> float:
    """About how many index entries there are: it decides how many tasks they are dealt over, not what is found."""
    schemes = [(docs, scheme_for(band, *_LIMITS[band], docs, percent)) for band, docs in in_band.items()]
    return 1.5 * sum(docs * (s.segments + s.double * (s.low + s.high) / 2 / s.segments) for docs, s in schemes)


def _in_rounds(made: Callable[[Column], DataFrame], head: str, rounds: int, folder: str, name: str) -> DataFrame:
    """The rows of `made` for each share of the heads; a share is written, and its shuffle files can go, before the next one begins."""
    some = [F.pmod(F.xxhash64(head), F.lit(rounds)) == r if rounds > 1 else F.lit(True) for r in range(rounds)]
    return reduce(DataFrame.union, [saved(made(share), folder, f"{name}-{r}") for r, share in enumerate(some)])


def _members_apart(compared: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Members of heads whose members are in several components: (head, node), and of what `_across` needs all but their long columns."""
    alpha, beta = 100 + percent, 100 - percent
    roots = parts.select("node", "root")
    entries = (F.size("far") + F.size("added") + F.size("lacked")).cast("long")
    rows = compared.select(F.col("a").alias("head"), F.col("b").alias("node"), "near", (alpha * (F.col("adds") + F.col("lacks")) - beta * F.col("size_b")).alias("u"), entries.alias("entries")).join(roots, "node", "left")
    rows = rows.withColumns({"root": F.xxhash64(F.coalesce("root", "node")), "h": F.xxhash64("node")})
    least = F.min(F.when(F.col("near"), F.struct("u", F.col("h").alias("node"), "root")))
    lots = F.ceil(F.sqrt(F.count(F.lit(1)) / LOT)).cast("int")
    several = rows.groupBy("head").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), least.alias("m0"), lots.alias("lots")).where("r0 <> r1").select("head", "m0", "lots")
    return rows.join(several, "head").withColumn("joined", F.coalesce(F.col("near") & (F.col("u") + F.col("m0.u") <= 0), F.lit(False)))


def _across(compared: DataFrame, apart: DataFrame, nodes: DataFrame, percent: int, rounds: int, folder: str) -> DataFrame:
    """Pairs (a, b) of members of one head that are in different components and may still be linked.

    A member m of a head differs from the centre c by what it adds and what it lacks. 1 - similarity is a metric, so the
    distances of two linked members from c differ by 1 - p at most: both are near (within 3 (1 - p)), or both are far (beyond
    2 (1 - p)), or both are either.

    * Near members are linked if u(a) + u(b) <= 2 (100 + p) shared, where u = (100 + p) (adds + lacks) - (100 - p) |m| and
      `shared` counts what both add and what both lack. Let m0 be the member of least u. Members with u + u(m0) <= 0 are linked
      with m0 whatever they share, so they are paired with m0 only. All other pairs share something: an added shingle,
      or only lacked ones, which is possible only if both add little. In both cases the sizes bound how long the
      prefixes are that must meet, and how many more shingles can be shared after the first that meets.
    * Far members are linked if they share p (|a| + |b|) / (100 + p) shingles; a prefix of each must share one.

    Prefixes start with what few members have, so what a whole group shares comes last. The first shared shingle leaves
    room for the others on both sides, which cuts off nearly all chance agreements in the join itself. So do sketches: linked
    sets differ in (100 - p) (|a| + |b|) / (100 + p) shingles at most, and their sketches in no more bits. So the pairs of a large
    group that share some shingles but too few are mostly not even made, as long as that bound is below half of a sketch's bits; beyond, they are compared.

    Members are dealt by head, those of large heads in lots by shingle, and their prefixes are exploded where they then are: what is exchanged
    are members, not the dozens of entries of each.
    """
    alpha, beta = 100 + percent, 100 - percent
    with_least = apart.where("joined AND root <> m0.root").select(F.col("m0.node").alias("node_1"), F.col("h").alias("node_2"))

    # A shingle of a prefix and how many follow it, in one long.
    placed = lambda name, length: F.transform(name, lambda x, i: F.shiftleft(x.cast("long"), 32).bitwiseOR((length - i - 1).cast("long"))).alias(name)
    in_lot = lambda name: F.filter(name, lambda x: F.pmod(F.hash(F.shiftright(x, 32)), "lots") == F.col("lot")).alias(name)
    numbers = ["h", "root", "joined", "u", F.col("size_b").cast("int").alias("size"), "lacks", *_SKETCHES]
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.shiftright(x, 32).alias("token"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("left"))
    entries = F.concat(*[F.transform(name, entry(kind)) for kind, name in enumerate(("far", "added", "lacked"))])
    far = F.col("kind") == 0
    columns = [
        "part", F.xxhash64("head", "kind", "token").alias("key"), F.col("h").alias("node"), "root", (F.col("joined") & ~far).alias("joined"), "left", F.when(far, 2 * percent * F.col("size")).otherwise(F.col("u")).alias("need"),
        F.when(F.col("kind") == 1, F.col("lacks")).otherwise(0).alias("beside"), "size", *_SKETCHES,
    ]
    differ = " + ".join(f"bit_count({c} ^ {c}_1)" for c in _SKETCHES)
    fits = f"{alpha} * CAST({differ} AS BIGINT) <= {beta} * (CAST(size AS BIGINT) + size_1) AND root <> root_1 AND (joined OR node_1 < node) AND need + need_1 <= {2 * alpha} * (1 + least(left, left_1) + least(beside, beside_1))"
    n = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = compared.select(F.col("a").alias("head"), F.col("b").alias("node"), "size_b", "adds", "lacks", *_SKETCHES, placed("far", F.col("size_b")), placed("added", F.col("adds")), placed("lacked", F.col("lacks")))

    def found_in(share: Column) -> DataFrame:
        members = whole.where(share).join(exploded(apart.where(share).select("head", "node", "h", "root", "joined", "u", "lots")), ["head", "node"])
        lots = members.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select(F.xxhash64("head", "lot").alias("part"), "head", *numbers, in_lot("far"), in_lot("added"), in_lot("lacked"))
        keyed = lots.repartition(n, "part").select("part", "head", "h", "root", "joined", "u", "size", "lacks", *_SKETCHES, F.inline(entries)).select(columns)
        one = keyed.where("NOT joined").select("part", "key", *[F.col(c).alias(f"{c}_1") for c in ("node", "root", "left", "need", "beside", "size", *_SKETCHES)])
        return exploded(one).join(exploded(keyed), ["part", "key"]).where(fits).select("node_1", F.col("node").alias("node_2")).distinct()

    found = _in_rounds(found_in, "head", rounds, folder, "found").union(with_least).distinct()
    named = nodes.select("node", F.xxhash64("node").alias("h"))
    for k in (1, 2):
        found = found.join(named.select(F.col("node").alias(f"n{k}"), F.col("h").alias(f"node_{k}")), f"node_{k}")
    return found.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()
