"""Language-model scoring with a hashed maximum-entropy model over a tree of the whole training vocabulary.

Every training token is below a leaf of a binary tree of classes that halve the training frequency: the `HEAD` most
frequent tokens get Shannon codes in the order of their counts, all others are dealt by hash to `TAIL_LEAVES` times the
root of the number of types leaves, at least one for four types. At each node a logistic model chooses the branch, from the
node's own frequency and from hashed features of the words before joined with the node: the word before, the skipped words two and
three places before, and the two words before as a bigram. So a class is chosen by factors of one bit, a softmax of two
each. Tail tokens that fall on one leaf divide it by their counts. Tokens unseen in training keep the add-half unigram.

Counts come from all training texts: they are summed within tasks, then shuffled by token. The weights are fitted in one
pass over all training texts, in synchronous rounds: each text belongs to one round, by its hash, and each round has as many
texts as all before it. In a round each task sums the gradients and curvatures of its texts at shared weights, the sums of
all tasks are added, and one damped Newton step follows. A round is a sum over texts, so file layout and partitions change
nothing but rounding. Tables grow with the roots of the numbers of tokens and types, since each task and the driver
hold them; contexts that share a row share its weight. At most `SUMMING_TASKS` tasks send their sums.

Token counts are broadcast while there are at most `BROADCAST_TOKENS` of them; beyond that, each text's distinct tokens
are joined with the counts in a shuffle. Both ways give the same scores. Tokens are compared by 64-bit hashes of
their lower-cased bytes.

Defined results: a null text is empty and has one token, its end; without training rows every token is
unseen; equal rows give equal results; an empty table gives no rows; clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import textbytes as tb
from foliomill.llm.common import saved, scratch_dir

#: Tokens with codes of their own; leaves of all others for each root of the number of types.
HEAD, TAIL_LEAVES = 1 << 16, 256
#: Shares of the training texts, in sixteenths, up to which each round goes.
ROUNDS = (1, 2, 4, 8, 16)
RATE, DAMPING, SUMMING_TASKS = 0.5, 4.0, 1024
BLOCK_ROWS = 1 << 14
BROADCAST_TOKENS = 4_000_000
FLUSH_TOKENS = 1 << 21
U = np.uint64
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)

SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass
class Tree:
    """Codes of the most frequent tokens (sorted by hash) and where those of others lie; node frequencies as logits; weights."""

    frequent: np.ndarray
    frequent_codes: np.ndarray
    frequent_lengths: np.ndarray
    span: tuple[int, int]
    tail_bits: int
    bias: np.ndarray
    weights: np.ndarray

    @classmethod
    def bare(cls) -> Tree:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), (0, 1), 0, np.zeros(2, np.float32), np.zeros(2, np.float32))

    def codes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each token, and its length in bits."""
        first, last = self.span
        codes = U(first) + (tb.mix(tokens + U(11)) % U(last - first))
        lengths = np.full(len(tokens), self.tail_bits, np.int64)
        at = _ids(tokens, self.frequent, np.arange(len(self.frequent)))
        some = at >= 0
        codes[some], lengths[some] = self.frequent_codes[at[some]], self.frequent_lengths[at[some]]
        return codes, lengths


def tokens_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and its end, and the bounds of rows."""
    starts, ends, bounds = tb.words(buf, offsets)
    out_bounds = bounds + np.arange(len(bounds))
    out = np.full(int(out_bounds[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[out_bounds[1:] - 1] = False
    out[inside] = tb.word_hashes(buf, starts, ends)
    return out, out_bounds


def _before(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[firsts] = START
    return out


def contexts(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each token: the word before, skips of one and two, and the two words before."""
    one = _before(tokens, bounds[:-1])
    two = _before(one, bounds[:-1])
    three = _before(two, bounds[:-1])
    return [tb.mix(one), tb.mix(two + U(1)), tb.mix(three + U(2)), tb.mix(one * U(3) + two)]


def _ids(tokens: np.ndarray, known: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Index of each token among known ones (sorted hashes; order gives their ids), -1 for none."""
    if not len(known):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, order[at], -1)


def _walk(tree: Tree, tokens: np.ndarray, bounds: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each token's leaf. With sums, adds to the gradients (real) and curvatures (imaginary) of the weights instead."""
    codes, lengths = tree.codes(tokens)
    order = np.argsort(-lengths.astype(np.int8), kind="stable")
    codes, lengths = codes[order], lengths[order]
    features = [c[order] for c in contexts(tokens, bounds)]
    # Of each length, how many tokens have more bits than that: a prefix, as they are in order
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(64), side="right")
    logs = np.zeros(len(tokens))
    room, shift = U(64 - int(np.log2(len(tree.weights)))), U(64 - int(np.log2(len(tree.bias))))
    for depth in range(64):
        n = int(active[depth])
        if not n:
            break
        left = lengths[:n] - depth
        node = ((U(1) << U(depth)) | (codes[:n] >> left.astype(np.uint64))) * U(0x9E3779B97F4A7C15)
        turn = (codes[:n] >> (left - 1).astype(np.uint64)) & U(1)
        z = tree.bias[node >> shift]
        at = [((f[:n] ^ node) * U(0xD6E8FEB86659FD93) >> room).view(np.int64) for f in features]
        for i in at:
            z += tree.weights[i]
        sign = turn.astype(np.float32) * 2 - 1
        far = np.exp(-np.clip(z * sign, -30, 30))
        if sums is None:
            logs[:n] -= np.log(1 + far)
            continue
        miss = far / (1 + far)
        both = sign * miss + 1j * (miss * (1 - miss)).astype(np.float64)  # one scattered addition for the two
        for i in at:
            np.add.at(sums, i, both)
    out = np.empty(len(tokens))
    out[order] = logs
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    held: list[np.ndarray] = []
    for batch in batches:
        for _, buf, offsets in tb.pieces(batch.column(0)):
            held.append(tokens_of(buf, offsets)[0])
            if sum(map(len, held)) >= FLUSH_TOKENS:
                yield flush(held)
                held = []
    if held:
        yield flush(held)


def _blocks(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for kind, x in enumerate(arrays):
        for block in range(0, len(x), BLOCK_ROWS):
            part = x[block : block + BLOCK_ROWS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([part.tobytes()])], names=["kind", "block", "sums"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["sums"])
            held = sums.setdefault((row["kind"], row["block"]), np.zeros(len(x)))
            held += x
    for (kind, block), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([x.tobytes()])], names=["kind", "block", "sums"])


_BLOCKS = "kind int, block int, sums binary"


def _added(parts: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The arrays that the blocks of all tasks add up to."""
    out = [np.zeros(n) for n in sizes]
    summed = parts.repartition("kind", "block").mapInArrow(_sum_blocks, _BLOCKS)
    for row in saved(summed, scratch_dir(parts.sparkSession), "sums").toLocalIterator():  # all rows are as large as the model
        x = np.frombuffer(row["sums"])
        out[row["kind"]][row["block"] : row["block"] + len(x)] = x
    return out


def _frequencies(shared):
    """Of each node, how often training tokens pass it and how often they take its second branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        passed, turned = np.zeros(len(tree.bias)), np.zeros(len(tree.bias))
        shift = U(64 - int(np.log2(len(tree.bias))))
        for batch in batches:
            codes, lengths = tree.codes(batch.column(0).to_numpy().view(np.uint64))
            n = batch.column(1).to_numpy().astype(np.float64)
            for depth in range(int(lengths.max(initial=0))):
                some = np.flatnonzero(lengths > depth)
                left = lengths[some] - depth
                node = ((U(1) << U(depth)) | (codes[some] >> left.astype(np.uint64))) * U(0x9E3779B97F4A7C15) >> shift
                np.add.at(passed, node, n[some])
                np.add.at(turned, node, n[some] * ((codes[some] >> (left - 1).astype(np.uint64)) & U(1)))
        yield from _blocks([passed, turned])

    return run


def _gradients(shared):
    """Sums over the texts: gradients and curvatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        sums = np.zeros(len(tree.weights), np.complex128)
        for batch in batches:
            for _, buf, offsets in tb.pieces(batch.column(0)):
                _walk(tree, *tokens_of(buf, offsets), sums)
        yield from _blocks([sums.real, sums.imag])

    return run


def plant(vocabulary: DataFrame, n_all: int, n_types: int) -> Tree:
    """The tree of (token, n) with the frequencies of its nodes."""
    # Written first: a limit that is collected sends so many rows of each task to the driver
    top = saved(vocabulary.orderBy(F.desc("n"), "token").limit(HEAD), scratch_dir(vocabulary.sparkSession), "top").toArrow()
    tokens, n = top.column(0).to_numpy(), top.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((tokens, -n))
    tokens, n = tokens[order].view(np.uint64), n[order]
    bits = lambda x: int(np.ceil(np.log2(max(x, 2))))
    lengths = np.ceil(np.log2(n_all / np.maximum(n, 1))).astype(np.int64) if len(n) else n
    starts = np.cumsum(n) - n
    # In Python's whole numbers: 62 bits would not hold start * 2**length
    codes = np.array([(int(s) << int(k)) // n_all for s, k in zip(starts, lengths, strict=True)], np.uint64)
    rest, rest_types = n_all - int(n.sum()), n_types - len(n)
    leaves = min(rest_types, max(rest_types // 4, 1), int(TAIL_LEAVES * n_types**0.5))
    tail_bits = bits(n_all * leaves / rest) if rest else 1
    # Rounded up: what is below may belong to the last of the head
    span = (-(-(1 << tail_bits) * int(n.sum()) // n_all), 1 << tail_bits) if rest else (0, 1)
    if rest and span[0] == span[1]:
        span, tail_bits = (2 * span[1] - 1, 2 * span[1]), tail_bits + 1
    order = np.argsort(tokens)
    room = (1 << bits(4 * (len(n) + leaves)), 1 << bits(max(64 * n_all**0.5, min(n_all, 1 << 18))))
    tree = Tree(tokens[order], codes[order], lengths[order], span, tail_bits, *(np.zeros(x, np.float32) for x in room))
    shared = vocabulary.sparkSession.sparkContext.broadcast(tree)
    passed, turned = _added(vocabulary.mapInArrow(_frequencies(shared), _BLOCKS), [len(tree.bias)] * 2)
    shared.destroy()
    return replace(tree, bias=np.log((turned + 0.01) / (passed - turned + 0.01)).astype(np.float32))


def train(texts: DataFrame, tree: Tree, rounds: tuple[int, ...] = ROUNDS) -> Tree:
    """texts: one text column; rounds: see `ROUNDS`."""
    spark, text = texts.sparkSession, texts.columns[0]
    part = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(rounds[-1]))
    for low, high in zip((0, *rounds), rounds, strict=False):
        shared = spark.sparkContext.broadcast(tree)
        own = texts.where((part >= low) & (part < high)).coalesce(SUMMING_TASKS)
        gap, curve = _added(own.mapInArrow(_gradients(shared), _BLOCKS), [len(tree.weights)] * 2)
        shared.destroy()  # else the driver keeps each round's model
        tree = replace(tree, weights=(tree.weights + RATE * gap / (curve + DAMPING)).astype(np.float32))
    return tree


def _leaves(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = shared.value.codes(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(((U(1) << lengths.astype(np.uint64)) | codes).view(np.int64))], names=["token", "n", "leaf"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()]) for c in batch.columns], names=batch.schema.names)


def _held(vocabulary: DataFrame, n_all: int, n_types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, counts and shares of all tokens. They are sorted by tasks, and come to the driver one partition at a time into arrays of the final size."""
    out = np.empty(n_types, np.uint64), np.empty(n_types, np.int32 if n_all < 1 << 31 else np.int64), np.empty(n_types, np.float32)
    first = 0
    in_order = vocabulary.select("token", "n", "share").orderBy(F.col("token") < 0, "token")  # as unsigned numbers
    for row in in_order.mapInArrow(_packed, "token binary, n binary, share binary").toLocalIterator():
        for x, packed, kind in zip(out, row, (np.uint64, np.int64, np.float32), strict=True):
            part = np.frombuffer(packed, kind)
            x[first : first + len(part)] = part
        first += len(part)
    return out


def _score(shared_tree, shared_counts, text_at: int):
    """Adds n_tokens; with counts also log_c, known and tree_log, else key and distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared_tree.value
        vocabulary, counts, shares = shared_counts.value if shared_counts else (None, None, None)
        row_no = 0
        for batch in batches:
            cols: dict[str, list] = {}
            for _, buf, offsets in tb.pieces(batch.column(text_at)):
                tokens, bounds = tokens_of(buf, offsets)
                total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731, B023  no row is without tokens
                logs = _walk(tree, tokens, bounds) / np.log(10)
                made = {"n_tokens": np.diff(bounds)}
                if shared_counts:
                    distinct, back = np.unique(tokens, return_inverse=True)
                    c, share = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
                    if len(vocabulary):
                        at = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
                        c = np.where(vocabulary[at] == distinct, counts[at], 0)
                        share = shares[at]
                    known = (c > 0)[back]
                    made |= {"log_c": total(np.log10(c + 0.5)[back]), "known": total(known.astype(np.int64)), "tree_log": total(np.where(known, logs + share[back], 0.0))}
                else:
                    base = TaskContext.get().partitionId() << 40
                    made["key"] = base + row_no + np.arange(len(bounds) - 1)
                    row_no += len(bounds) - 1
                    lists = [np.unique(tokens[s:e], return_inverse=True, return_counts=True) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    token, tf = np.concatenate([x[0] for x in lists]), np.concatenate([x[2] for x in lists])
                    sums = np.concatenate([np.bincount(x[1], logs[s:e]) for x, s, e in zip(lists, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
                    struct = pa.StructArray.from_arrays([pa.array(token.view(np.int64)), pa.array(tf), pa.array(sums)], names=["token", "tf", "logs"])
                    ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])])
                    made["distinct"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
                for k, v in made.items():
                    cols.setdefault(k, []).append(v if isinstance(v, pa.Array) else pa.array(v))
            names = _COUNTED if shared_counts else _KEYED
            kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != text_at]
            if cols:
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.concat_arrays(cols[n]) for n in names], names=[n for n, _ in kept] + list(names))

    return run


_COUNTED = ("n_tokens", "log_c", "known", "tree_log")
_KEYED = ("n_tokens", "key", "distinct")
_KINDS = {"log_c": "double", "tree_log": "double", "distinct": "array<struct<token:long,tf:long,logs:double>>"}


def score_texts(docs: DataFrame, trains: Column, text: str = "text", rounds: tuple[int, ...] = ROUNDS, broadcast_tokens: int = BROADCAST_TOKENS, folder: str | None = None) -> DataFrame:
    """Add the columns of `SCORES` to documents, without their text; rows where `trains` holds are learnt from."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    docs = docs.drop(*SCORES)
    training = docs.where(trains).select(text)
    plain = saved(training.mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), folder, "plain")
    n_all, n_types = plain.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tree = plant(plain, n_all, n_types) if n_all else Tree.bare()
    planted = spark.sparkContext.broadcast(tree)
    leaves = plain.mapInArrow(_leaves(planted), "token long, n long, leaf long")
    on_leaf = leaves.groupBy("leaf").agg(F.sum("n").alias("n_leaf"))
    vocabulary = saved(leaves.join(on_leaf, "leaf").select("token", "n", F.log10(F.col("n") / F.col("n_leaf")).cast("float").alias("share")), folder, "vocabulary")
    planted.destroy()
    if n_all:
        tree = train(training, tree, rounds)
    base_room = float(np.log10(n_all + 0.5 * (n_types + 1)))
    seen = float(np.log10(n_all + 0.5 * n_types)) - base_room if n_all else 0.0

    at = docs.columns.index(text)
    own = [f for f in docs.schema if f.name != text]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    made = lambda names: ", ".join([kept, *(f"{n} {_KINDS.get(n, 'long')}" for n in names)])
    shared = spark.sparkContext.broadcast(tree)
    if n_types <= broadcast_tokens:
        counted = docs.mapInArrow(_score(shared, spark.sparkContext.broadcast(_held(vocabulary, n_all, n_types)), at), made(_COUNTED))
    else:
        keyed = saved(docs.mapInArrow(_score(shared, None, at), made(_KEYED)), folder, "keyed")
        flat = keyed.select("key", F.inline("distinct")).join(vocabulary, "token", "left")
        c = F.coalesce("n", F.lit(0))
        sums = flat.groupBy("key").agg(
            F.sum(F.col("tf") * F.log10(c + 0.5)).alias("log_c"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.when(c > 0, F.col("logs") + F.col("tf") * F.col("share")).otherwise(0.0)).alias("tree_log")
        )
        counted = keyed.drop("distinct").join(sums, "key").drop("key")
    unseen = F.col("n_tokens") - F.col("known")
    return counted.select(
        *[f"`{f.name}`" for f in own],
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * base_room).alias("base_score"),
        (F.col("tree_log") + F.col("known") * seen + unseen * (float(np.log10(0.5)) - base_room)).alias("score"),
    )
