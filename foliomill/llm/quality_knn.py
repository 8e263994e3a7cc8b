"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text becomes hashed features: its words, and 3-grams of character classes (which show layout, symbols and
capitals), each log-scaled and weighted by rarity, and a few ratios in steps (repeated words and lines, word
length, capitals, symbols). A truncated SVD of a bounded sample of labelled rows gives the latent space;
the sample's own vectors are the neighbours. Every document's cosines to all of them are computed exactly, in
blocks, as matrix products; the `neighbours` most similar vote with their labels, weighted by similarity.

Sample, projection and vectors are bounded by `train_rows`, `FEATURES` and `rank`, whatever the input: about
2 MB that each worker holds. All texts are read whole.

Defined results: null and empty texts have the empty text's features and are scored alike; the score is 0 to 1,
higher where label 1 is likelier; without any label the score is 0.5; ties among neighbours go to the first by
id hash; of several texts with one id the one with the least hash is learnt from; equal rows give results that are equal
but for rounding (a millionth); long texts are read whole; an empty table gives no rows; a column named `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import textbytes as tb
from foliomill.llm.common import unit_hash

WORDS, CLASSES, STEPS = 2048, 2048, 16
RATIOS = 6
FEATURES = WORDS + CLASSES + RATIOS * STEPS

#: Character classes of bytes: every printable ASCII symbol is one of its own, letters and digits share theirs.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


@dataclass
class Neighbours:
    weights: np.ndarray  # of each feature
    projection: np.ndarray  # features x rank
    vectors: np.ndarray  # rows x rank, of length 1
    labels: np.ndarray


def _ratios(buf: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ratios in 0..1 of each row."""
    n_words = np.maximum(np.diff(bounds), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n_bytes = np.maximum(np.diff(offsets), 1)
    distinct = np.diff(tb.distinct_in_rows(hashes, bounds)[1])
    pair, pair_bounds = tb.shingle_hashes(hashes, bounds, 2)
    pairs = np.diff(tb.distinct_in_rows(pair, pair_bounds)[1])
    symbol = (buf < 128) & ~tb.SPACE[buf] & (_CLASS[buf] != 48) & (_CLASS[buf] != 65) & (_CLASS[buf] != 97)
    return np.stack(
        [distinct / n_words, pairs / np.maximum(np.diff(pair_bounds), 1), np.minimum(np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[bounds]) / n_words / 20, 1), sums(_CLASS[buf] == 65) / n_bytes, np.minimum(sums(symbol) / n_bytes * 2, 1), np.minimum(np.log2(n_words) / 16, 1)], 1
    )


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Feature matrices (float32) of consecutive rows."""
    for _, buf, offsets in tb.pieces(texts):
        n = len(offsets) - 1
        starts, ends, bounds = tb.words(buf, offsets)
        hashes = tb.word_hashes(buf, starts, ends)
        row = np.repeat(np.arange(n), np.diff(bounds))
        words = np.bincount(row * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        c = _CLASS[buf]
        if len(c) > 2:
            gram = tb.mix(c[:-2] * np.uint64(65536) + c[1:-1] * np.uint64(256) + c[2:]) % np.uint64(CLASSES)
            row = np.repeat(np.arange(n), np.diff(offsets))
            inside = row[:-2] == row[2:]
            grams = np.bincount((row[:-2] * CLASSES + gram.astype(np.int64))[inside], minlength=n * CLASSES).reshape(n, CLASSES)
        else:
            grams = np.zeros((n, CLASSES))
        out = np.zeros((n, FEATURES), np.float32)
        for part, at in ((words, 0), (grams, WORDS)):
            scaled = np.log1p(part).astype(np.float32)
            out[:, at : at + part.shape[1]] = scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
        ratios = _ratios(buf, offsets, hashes, starts, ends, bounds)
        step = np.minimum((ratios * STEPS).astype(int), STEPS - 1)
        for j in range(RATIOS):
            out[np.arange(n), WORDS + CLASSES + j * STEPS + step[:, j]] = 0.35
        yield out


def _project(x: np.ndarray, weights: np.ndarray, projection: np.ndarray) -> np.ndarray:
    v = (x * weights) @ projection
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text", train_rows: int = 2000, rank: int = 64, seed: str = "knn-1") -> Neighbours:
    """Neighbours from at most `train_rows` labelled, usable rows: those with the least hashed ids."""
    chosen = labels.where(usable & F.col(label).isNotNull()).select(F.col(id_col), F.col(label).cast("int").alias("__label"), unit_hash(seed, F.col(id_col)).alias("__u")).orderBy("__u", id_col).limit(train_rows)
    rows = docs.select(id_col, F.col(text).alias("__text")).join(F.broadcast(chosen), id_col).select("__u", id_col, "__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row.astype(np.float16).tobytes() for x in features(batch.column(2)) for row in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["u", "label", "x"])

    # One text for each chosen label, so as many rows as labels at most.
    one = rows.groupBy("__u", id_col, "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("__u", "__label", "__text")
    found = sorted(one.mapInArrow(run, "u long, label int, x binary").collect(), key=lambda r: (r["u"], r["x"]))
    if not found:
        return Neighbours(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    y = np.array([r["label"] for r in found], np.float32)
    weights = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    scaled = x * weights
    # Randomised range finder with two power iterations (Halko et al. 2011).
    start = scaled @ np.random.default_rng(0).standard_normal((FEATURES, min(rank + 16, len(x)))).astype(np.float32)
    for _ in range(2):
        start = scaled @ (scaled.T @ np.linalg.qr(start)[0])
    basis = np.linalg.qr(start)[0]
    _, _, vt = np.linalg.svd(basis.T @ scaled, full_matrices=False)
    projection = np.ascontiguousarray(vt[:rank].T)
    return Neighbours(weights, projection, _project(x, weights, projection), y)


def vote(vectors: np.ndarray, model: Neighbours, neighbours: int) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(vectors), 0.5)
    k = min(neighbours, len(model.labels))
    out = np.empty(len(vectors))
    different, which = np.unique(model.vectors, axis=0, return_inverse=True)  # equal vectors get equal cosines
    for at in range(0, len(vectors), 512):
        cos = (vectors[at : at + 512] @ different.T)[:, which.ravel()]
        least = np.partition(cos, -k, axis=1)[:, -k, None]
        nearer, tied = cos > least, cos == least
        near = nearer | (tied & (np.cumsum(tied, axis=1) <= k - nearer.sum(1, keepdims=True)))
        weight = np.where(near, np.maximum(cos, 0).astype(np.float64) ** 4 + 1e-9, 0)
        out[at : at + 512] = weight @ model.labels.astype(np.float64) / weight.sum(1)
    return np.clip(out, 0, 1)


def classify(docs: DataFrame, model: Neighbours, text: str = "text", neighbours: int = 15) -> DataFrame:
    """Add `score` (double) to documents."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Neighbours = shared.value
        for batch in batches:
            scores = [vote(_project(x, own.weights, own.projection), own, neighbours) for x in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")
