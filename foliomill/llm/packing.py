"""Packs documents into training sequences of a fixed number of tokens.

Method: sum-of-squares packing. Pieces come one after another; each goes where the sum of the squared counts of open sequences per
gap (capacity left) becomes smallest, be it into an open sequence or a new one. That keeps gaps varied, so later
pieces find a place that they fill. Only gaps are counted, so a step looks at `capacity` numbers at most.

Pieces are dealt by hash into groups of about `GROUP`, each packed in one task. What lies in sequences that are still open at the end of a
group (about as many sequences at any size of a group) is taken out and dealt again in the next round, into fewer groups. When one
group is left, or a round could close less than half, pieces come by falling length, and a sequence is opened only if no
open one has room; rounds end with one group, or when that closes less than half. Every round is written to the shared folder; only ids, numbers and lengths move, no text.

Defined results: a null text is an empty one: its end id alone. A document of more than `capacity` ids is cut into pieces of that length,
of which the first may be shorter; others are whole. Equal rows are packed each for itself. Nothing is dropped. Which pieces share a
sequence depends on the order of files (it decides a piece's key), never on a length of text or the number of tasks of a shuffle.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import saved, scratch_dir

#: Pieces that one task packs; a piece is a row of a few numbers.
GROUP = 1 << 16
#: Characters of text that are encoded before their rows are sent back.
BATCH_CHARS = 1 << 22

PIECE = ["piece", "start", "length", "ids_crc32"]


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and all others, in order, as U+0100 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids without special tokens, by a `tokenizers` file.

    A byte-level BPE whose ids follow its merges needs nothing else than its ranks; `tiktoken` applies those several times
    faster, with the same ids. Any other file is left to `tokenizers`.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model["vocab"]
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if plain and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
        letters = _bytes_of_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_ordinary(t) for t in texts]
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of docs without the text, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = [*PIECE, *(["ids"] if keep_ids else [])]
    kept = [c for c in docs.columns if c not in {text_col, *names}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def rows(batch: pa.RecordBatch, first: int, texts: list[str], encode: Callable) -> pa.RecordBatch:
        where, cut = [], []
        for k, ids in enumerate(encode(texts)):
            data = np.array([*ids, end_id], dtype="<u4")
            head = len(data) % capacity if len(data) > capacity else len(data)
            bounds = [*([0] if head else []), *range(head, len(data) + 1, capacity)]
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                where.append(first + k)
                cut.append((p, a, b - a, zlib.crc32(data[a:b].tobytes()), *([data[a:b].tolist()] if keep_ids else [])))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.field("element", pa.int64(), False))]
        added = [pa.array(list(values), t) for values, t in zip(zip(*cut), types)]
        same = batch.take(pa.array(where, pa.int64()))
        return pa.RecordBatch.from_arrays([*(same.column(k) for k in range(len(kept))), *added], [*kept, *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            first, texts, size = 0, [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column(len(kept))[k].as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield rows(batch, first, texts, encode)
                    first, texts, size = k + 1, [], 0
            if texts:
                yield rows(batch, first, texts, encode)

    fields = [T.StructField("piece", T.IntegerType(), False), *(T.StructField(c, T.LongType(), False) for c in PIECE[1:])]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType(), False), False))
    return source.mapInArrow(work, T.StructType([*(source.schema[c] for c in kept), *fields]))


class Packer:
    """Sum-of-squares packing of lengths, in the order in which they come.

    A piece of length s in a sequence with gap g takes one from the count of g and adds one to that of g - s; a full
    sequence is closed and counts no more. Equal changes go to the smaller gap.
    """

    def __init__(self, capacity: int, reluctant: bool = False) -> None:
        self.capacity, self.reluctant = capacity, reluctant
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for one more piece."""
        n, cap = self.counts, self.capacity
        gap = cap
        room = n[size:cap]
        if len(room):
            change = 2 * (n[: cap - size] - room) + 2
            if len(change):
                change[0] = 1 - 2 * room[0]
            change = np.where(room > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
            if room[best] and (self.reluctant or change[best] <= 2 * n[cap - size] + 1):
                gap = size + best
        if gap == cap:
            sequence = len(self.fill)
            self.fill.append(0)
        else:
            sequence = self.open[gap].pop()
            n[gap] -= 1
        offset = self.fill[sequence]
        self.fill[sequence] += size
        left = gap - size
        if left:
            n[left] += 1
            self.open[left].append(sequence)
        return sequence, offset


def _pack_group(table: pa.Table, capacity: int, reluctant: bool) -> pa.Table:
    """Adds place (number of a sequence in the group), offset and whether the sequence got full."""
    order = np.array(table.column("__order"), dtype=np.int64)
    sizes = np.array(table.column("length"), dtype=np.int64)
    table = table.take(pa.array(np.lexsort((order, -sizes)) if reluctant else np.argsort(order, kind="stable")))
    packer = Packer(capacity, reluctant=reluctant)
    places = np.array([packer.place(s) for s in table.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
    full = np.array(packer.fill, dtype=np.int64)[places[:, 0]] == capacity
    for name, values in (("__place", places[:, 0]), ("offset", places[:, 1]), ("__full", full)):
        table = table.append_column(name, pa.array(values))
    return table


def _round(pieces: DataFrame, groups: int, number: int, capacity: int, reluctant: bool) -> DataFrame:
    key = F.col("__key")
    dealt = pieces.withColumns({"__group": F.pmod(F.xxhash64(key, F.lit(number)), F.lit(groups)), "__order": F.xxhash64(F.lit(number), key)})
    out = T.StructType([*dealt.schema.fields, T.StructField("__place", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__full", T.BooleanType())])
    packed = dealt.groupBy("__group").applyInArrow(lambda t: _pack_group(t, capacity, reluctant), out)
    return packed.withColumn("sequence_id", F.lit(number << 56) + F.shiftleft("__group", 24) + F.col("__place")).drop("__group", "__order", "__place")


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity; other columns pass through.

    Sequences that one whole piece fills have negative ids.
    """
    folder = scratch_dir(pieces.sparkSession)
    rows = saved(pieces.drop("sequence_id", "offset").withColumn("__key", F.monotonically_increasing_id()), folder, "pieces")
    whole = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("__key"), "offset": F.lit(0).cast("long")})
    done, todo, number, reluctant = [whole.drop("__key")], rows.where(F.col("length") < capacity), 0, False
    count = todo.count()
    while count:
        groups = -(-count // group)
        reluctant = reluctant or (groups == 1 and number > 0)
        packed = saved(_round(todo, groups, number, capacity, reluctant), folder, f"round-{number}")
        left = packed.where("NOT __full").count()
        if reluctant and (groups == 1 or 2 * left > count):
            done.append(packed.drop("__key", "__full"))
            break
        done.append(packed.where("__full").drop("__key", "__full"))
        todo = packed.where("NOT __full").drop("__full", "sequence_id", "offset")
        count, reluctant, number = left, reluctant or 2 * left > count, number + 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return placed


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most capacity), starts (offsets at which pieces begin)."""
    part = F.struct("offset", F.col(ids_col).alias("ids"))
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    return grouped.select("sequence_id", F.flatten("__parts.ids").alias("ids"), F.col("__parts.offset").alias("starts"))
