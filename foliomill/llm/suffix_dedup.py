"""Removal of long repeated byte strings, with suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else in the corpus: in another text,
or in the same one, overlapping or not. All strings are judged on the input.

1. Where equal strings could meet. In every text, each string of `length` bytes picks the q-gram inside it with the
   least hash (winnowing, Schleimer et al. 2003). Equal strings pick equal q-grams, so strings are grouped by
   what they pick. Neighbouring strings that pick the same one form a run. Groups with one run are unique.
2. Equal runs. Runs of a group with the same bytes are aggregated: if there are two, all their strings repeat.
   One of each different run goes on, so copies, however many, are sorted once.
3. Suffix arrays. The different runs of some groups are joined, sorted by induced sorting, and compared by permuted
   common prefixes; strings that share `length` bytes or more with a neighbour repeat. Groups are dealt to tasks by
   hash and sorted in shards of about `SHARD_BYTES`.
4. Groups of more than `GROUP_BYTES` are dealt anew by more of their content: strings at similar distances
   from their q-gram share a core of nearly `length` bytes, whose hash splits the group; what is still too large is dealt
   by whole strings, which needs no sorting. So no task holds an unbounded group, and no row is dropped.

Passages that are too short in bytes to go, but long in words, are reported beside that: `n_repeat_windows` counts the
strings of `words` consecutive words (A-Z as a-z) that another document has too. Each picks the group of 16 words with the least hash;
only the strings of groups that two texts share are compared.

Texts are told apart by the MD5 of their bytes, and so are strings in step 2 and whole strings in step 4. Other
hashes only decide what meets: strings that agree by chance are told apart when they are sorted.

Defined results: a null text is empty; a null id changes nothing; memory for one text is some sixty bytes for each of its
bytes, and texts of a gigabyte or more are refused; texts shorter than `length` lose nothing; equal rows are copies of each
other, which lose everything if they are long enough; an empty table gives no rows; columns named `n_bytes`, `removed`,
`kept` or `n_repeat_windows` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import textbytes as tb
from foliomill.llm.common import saved, scratch_dir
from foliomill.llm.suffix_array import permuted_common_prefixes, suffix_array

GRAM = 64
SHARD_BYTES = 1 << 20
GROUP_BYTES = 3 << 19
#: Strings of one group whose distances to their q-gram differ by less than this part of their length share a core.
CORE_STEPS = 8
U = np.uint64
_POS = U(30)
_POS_MASK = U((1 << 30) - 1)


class _Text:
    """Hashes of any piece of a text in constant time."""

    def __init__(self, body: bytes):
        if len(body) > int(_POS_MASK):
            raise ValueError(f"a text of {len(body)} bytes: places have {int(_POS)} bits")
        self.buf = np.frombuffer(body, np.uint8)
        self.up, self.down = tb.powers(len(body))
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + U(1)) * self.up[: len(body)], out=self.sums[1:])

    def digests(self, start: np.ndarray, end: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """MD5 of pieces, each with a number."""
        body = self.buf.tobytes()
        found = [hashlib.md5(b"%d " % n + body[s:e]).digest() for s, e, n in zip(start.tolist(), end.tolist(), beside.tolist(), strict=True)]
        return np.array([*found, b""], object)[:-1]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tb.mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(text: _Text, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q-grams picked by the strings of a text: (hash, place, first string, one past the last string)."""
    n, gram = len(text.buf), min(GRAM, max(length // 2, 1))
    if n < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = tb.mix((text.sums[gram:] - text.sums[:-gram]) * text.down[: n - gram + 1])
    # The least hash wins, and of equal ones the last.
    least = (h >> _POS << _POS) | (_POS_MASK - np.arange(len(h), dtype=np.uint64))
    window, width = length - gram + 1, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: width - window], least[window - width :])
    place = (_POS_MASK - (least & _POS_MASK)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]], place[first], first, np.append(first[1:], len(place))


def _runs(text: _Text, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings: (group, content, first string, number of strings, whether the q-gram occurs again in the run)."""
    group, place, first, last = anchors(text, length)
    if not len(group):
        return (group, np.zeros(0, object), first, first, first)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(new[1:], len(group)) - 1
    start, stop = first[new], last[end]
    content = text.digests(start, stop - 1 + length, place[new] - start)
    return group[new], content, start, stop - start, (end > new).astype(np.int64)


def _split_runs(text: _Text, length: int, start: int, count: int, step: int) -> tuple[np.ndarray, ...]:
    """The same for the strings of a run, grouped by the cores of `step` strings at a time."""
    if step == 1:
        at = np.arange(start, start + count)
        whole = text.hashes(at, at + length)
        return whole, text.digests(at, at + length, np.zeros(count, np.int64)), at, np.ones(count, np.int64), np.zeros(count, np.int64)
    group, place, first, last = anchors(text, length)
    mine = (first < start + count) & (last > start)
    out = []
    for g, p, a, b in zip(group[mine], place[mine].tolist(), np.maximum(first[mine], start).tolist(), np.minimum(last[mine], start + count).tolist(), strict=True):
        s = np.arange(a, b)
        block = (p - s) // step
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        s0, s1, nth = s[cut], np.append(s[cut[1:]], b), block[cut]
        low, high = p - nth * step, p - (nth + 1) * step + 1 + length  # what all strings at these distances hold
        out.append((tb.mix(text.hashes(low, high) + g + nth.astype(np.uint64) * U(31)), text.digests(s0, s1 - 1 + length, p - s0), s0, s1 - s0, np.zeros(len(cut), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_RUNS = "array<struct<grp:long,content:binary,first:long,count:long,again:long>>"


def _run_lists(rows: list[tuple[np.ndarray, ...]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    columns = [np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, object if j == 1 else np.int64) for j in range(5)]
    struct = pa.StructArray.from_arrays([pa.array(c, pa.binary()) if c.dtype == object else pa.array(c.view(np.int64)) for c in columns], names=["grp", "content", "first", "count", "again"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def _find_runs(length: int):
    """Batches of (text) to (key, n_bytes, runs). A text's second copy in a batch has no runs of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                bodies = [(x.as_py() or "").encode() for x in batch.column(0).slice(at, 512)]
                rows = [_runs(_Text(b), length) for b in bodies]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary()), pa.array([len(b) for b in bodies], pa.int64()), _run_lists(rows)], names=["key", "n_bytes", "runs"])

    return run


def _resplit(length: int, step: int):
    """Batches of (key, text, parts: list of (first, count, n)) to (key, n, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = _Text((batch.column(1)[i].as_py() or "").encode())
                parts = batch.column(2)[i].as_py()
                rows = [_split_runs(text, length, p["first"], p["count"], step) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), pa.binary()), pa.array([p["n"] for p in parts], pa.int64()), _run_lists(rows)], names=["key", "n", "runs"])

    return run


def _cut(length: int):
    """Batches of (key, text, parts) to one row for each part, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(at, min(at + 64, batch.num_rows)):
                    key, body = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or "").encode()
                    for p in batch.column(2)[i].as_py():
                        for column, value in zip(out, (p["grp"], key, p["first"], p["count"], body[p["first"] : p["first"] + p["count"] - 1 + length]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["grp", "key", "first", "count", "body"])

    return run


def repeated_strings(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some byte strings, whether what starts at a place repeats (in any of them) for `length` bytes."""
    sizes = np.array([len(b) for b in bodies])
    s = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s[starts + sizes] = 0  # a symbol that no byte has
    sa = suffix_array(s, 257)
    shared = permuted_common_prefixes(s, sa)
    hit = shared[sa] >= length
    repeats = np.zeros(len(s), bool)
    repeats[sa[hit]] = True
    repeats[sa[np.flatnonzero(hit) - 1]] = True
    return [repeats[a : a + max(n - length + 1, 0)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _sort_shards(length: int):
    """Batches of parts in the order of their groups to removed (key, first, last) byte ranges."""

    def shard(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        keys, lows, highs = [], [], []
        for (key, first, _), marks in zip(rows, repeated_strings([r[2] for r in rows], length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                keys.append(key)
                lows.append(first + a)
                highs.append(first + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size, group = 0, None
        for batch in batches:
            for grp, key, first, body in zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 4)), strict=True):
                if grp != group and size >= SHARD_BYTES:
                    yield shard(held)
                    held, size = [], 0
                group = grp
                held.append((key, first, body))
                size += len(body)
        if held:
            yield shard(held)

    return run


def _drop_ranges(text_at: int, names: list[str]):
    """Cut the ranges of each row out of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n_bytes, removed, kept = [], [], []
                for text, ranges in zip(part.column(text_at), part.column(batch.schema.names.index("__ranges")), strict=True):
                    body = (text.as_py() or "").encode()
                    spans: list[list[int]] = []
                    for r in sorted((r["low"], r["high"]) for r in ranges.as_py() or ()):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1])
                        else:
                            spans.append(list(r))
                    edges = [0, *(x for s in spans for x in s), len(body)]
                    n_bytes.append(len(body))
                    removed.append([{"start": s, "length": e - s} for s, e in spans])
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                repeated = pc.fill_null(part.column(batch.schema.names.index("__windows")), 0)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(n_bytes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()), repeated], names=[*names, "n_bytes", "removed", "kept", "n_repeat_windows"])

    return run


def _word_windows(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of so many consecutive words: (row, group that it picks, hash). Hashes of words are mixed, and no
    string has a thousand words, so polynomials of them tell strings apart."""
    starts, ends, bounds = tb.words(buf, offsets)
    h = tb.word_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    n = len(h) - words + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gram = min(16, words)
    sums = np.concatenate([[U(0)], np.cumsum(h)])
    least = tb.mix(sums[gram:] - sums[:-gram])
    window, width = words - gram + 1, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: width - window], least[window - width :])
    up, down = tb.powers(len(h))
    places = np.concatenate([[U(0)], np.cumsum(h * up[: len(h)])])
    whole = tb.mix((places[words:] - places[:-words]) * down[:n])
    inside = row[:n] == row[words - 1 :]
    return row[:n][inside], least[inside], whole[inside]


def _picked_groups(words: int):
    """Batches of (text) to (key, windows, groups): how many strings of words a text has, and what they pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in tb.pieces(batch.column(0)):
                row, group, _ = _word_windows(buf, offsets, words)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(offsets))), pa.int32()), pa.array(group[new].view(np.int64)))
                body = buf.tobytes()
                keys = [hashlib.md5(body[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.bincount(row, minlength=len(keys)).astype(np.int64)), lists], names=["key", "windows", "groups"])

    return run


def _windows_of(words: int):
    """Batches of (key, text, groups) to (key, hash) for each string of words that picks one of the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in tb.pieces(batch.column(1)):
                row, group, whole = _word_windows(buf, offsets, words)
                lists = [np.array(x.as_py(), np.int64).view(np.uint64) for x in batch.column(2).slice(first, len(offsets) - 1)]
                upto = np.searchsorted(row, np.arange(len(offsets)))
                found = np.concatenate([np.isin(group[a:b], x) for a, b, x in zip(upto[:-1], upto[1:], lists, strict=True)])
                keys = batch.column(0).slice(first, len(offsets) - 1).take(pa.array(row[found]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(whole[found].view(np.int64))], names=["key", "hash"])

    return run


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _grouped(runs: DataFrame, length: int, folder: str, name: str) -> DataFrame:
    """runs: key, n, grp, content, first, count, again. One row for each different run of a group that may repeat:
    how often it occurs (n), and the runs (different) and bytes (size) of its group."""
    equal = runs.groupBy("grp", "content").agg(F.sum("n").alias("n"), F.min(F.struct("key", "first", "count", "again")).alias("one"))
    of_group = equal.groupBy("grp").agg(F.count(F.lit(1)).alias("different"), F.sum(F.col("one.count") + length).alias("size"))
    joined = equal.join(of_group, "grp").where("n > 1 OR different > 1 OR one.again > 0")
    return saved(joined.select("grp", "content", "n", "different", "size", "one.*"), folder, name)


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", folder: str | None = None, group_bytes: int = GROUP_BYTES, words: int = 51) -> DataFrame:
    """Documents with `n_bytes` (long), `removed` (array of start and length in bytes), `kept` (binary) and `n_repeat_windows`
    (long), without their text."""
    folder = folder or scratch_dir(docs.sparkSession)
    docs = docs.drop("n_bytes", "removed", "kept", "n_repeat_windows")
    bodies_in = docs.select(F.col(text).alias("text"))
    worded = bodies_in.mapInArrow(_picked_groups(words), "key binary, windows long, groups array<long>").where("windows > 0")
    passages = saved(worded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"), F.first("groups").alias("groups")), folder, "passages")
    picked = passages.select("key", F.explode(F.array_distinct("groups")).alias("grp"))
    several = picked.groupBy("grp").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("grp")
    shared = saved(picked.join(several, "grp").groupBy("key").agg(F.collect_list("grp").alias("groups")), folder, "shared")  # of one text
    found = bodies_in.mapInArrow(_find_runs(length), f"key binary, n_bytes long, runs {_RUNS}")
    texts = saved(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("runs").alias("runs")), folder, "runs")
    ranges = [texts.where(f"n > 1 AND n_bytes >= {length}").select("key", F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high"))]

    runs = texts.select("key", "n", F.inline("runs"))
    whole_run = ("key", F.col("first").alias("low"), (F.col("first") + F.col("count") - 1 + length).alias("high"))
    bodies = to_sort = None
    steps = (0, max(length // CORE_STEPS, 1), 1)
    for level, step in enumerate(steps):
        groups = _grouped(runs, length, folder, f"groups-{level}")
        twice = groups.where("n > 1").select("grp", "content")
        ranges.append(runs.join(twice, ["grp", "content"], "left_semi").select(*whole_run))
        if level == 2:
            break
        open_groups = groups.where("different > 1 OR n = 1")
        small = open_groups.where(f"size <= {group_bytes}").select("key", "grp", "first", "count")
        to_sort = small if to_sort is None else to_sort.union(small)
        if bodies is None:
            wanted = open_groups.select("key").union(shared.select("key")).distinct()
            once = docs.select(_key(F.col(text)).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
            bodies = saved(once.join(wanted, "key", "left_semi"), folder, "bodies")
        large = open_groups.where(f"size > {group_bytes}")
        if large.isEmpty():
            break
        parts = large.groupBy("key").agg(F.collect_list(F.struct("first", "count", "n")).alias("parts"))  # of one text
        runs = saved(bodies.join(parts, "key").mapInArrow(_resplit(length, steps[level + 1]), f"key binary, n long, runs {_RUNS}"), folder, f"split-{level}").select("key", "n", F.inline("runs"))

    parts = to_sort.groupBy("key").agg(F.collect_list(F.struct("grp", "first", "count")).alias("parts"))  # of one text
    pieces = bodies.join(parts, "key").select("key", "text", "parts").mapInArrow(_cut(length), "grp long, key binary, first long, count long, body binary")
    ranges.append(pieces.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sort_shards(length), "key binary, low long, high long"))

    everything = ranges[0]
    for r in ranges[1:]:
        everything = everything.union(r)
    of_text = everything.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("__ranges"))  # of one text
    windows = bodies.join(shared, "key").select("key", "text", "groups").mapInArrow(_windows_of(words), "key binary, hash long")
    in_text = saved(windows.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("times")), folder, "windows")
    elsewhere = in_text.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("hash")
    repeated = in_text.join(elsewhere, "hash", "left_semi").groupBy("key").agg(F.sum("times").alias("found"))
    # All strings of a copied text occur in its copies.
    counted = passages.select("key", F.when(F.col("n") > 1, F.col("windows")).alias("all")).join(repeated, "key", "left").select("key", F.coalesce("all", "found").alias("__windows")).where("__windows > 0")
    of_text = saved(of_text.join(counted, "key", "full"), folder, "ranges")
    joined = docs.withColumn("__key", _key(F.col(text))).join(of_text.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    own = [f for f in docs.schema if f.name != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    return joined.mapInArrow(_drop_ranges(joined.columns.index(text), [f.name for f in own]), f"{fields}n_bytes long, removed array<struct<start:long,length:long>>, kept binary, n_repeat_windows long")
