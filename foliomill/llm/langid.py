"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts every substring of a training text. A document is parsed greedily
into the longest phrases that each automaton accepts (cross-parsing, Ziv and Merhav 1993); the language that needs the
fewest phrases, each counted as log2 of its training length, wins. Letters are lower-cased; anything between
letters is one space.

Every usable text is cut into passages of `passage` characters, from its start to its end; the training text of a
language is made of the `train_rows` passages with the least hashes among all of them: a bounded sample of labelled
passages, whose size depends neither on the number of documents nor on their lengths. Automata are hash tables of
their transitions, at most three for each training character whatever the alphabet. At most `MOST_LANGUAGES`
languages are learnt, which bounds what is collected and broadcast; more are refused, not dropped. A language none
of whose sampled passages has a letter is not learnt.

Predictions use whole texts, and phrases run on across the blocks that long texts are split into: blocks are parsed
side by side from guessed states, and again from the state in which the block before ends until none changes.

Defined results: a null text, or one without letters, is `und` with score 0; so is everything if no row is
labelled. The score is how much fewer phrases the best language needs than the next, 0 to 1 (1 if only one
language is known). Ties go to the first language by name. Equal rows give equal results, and count once as training
passages if their ids are equal too; an empty table gives no rows; columns named `lang_pred` or `score` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Letters and spaces of a text parsed in a row before the next block of the same text is begun beside it.
BLOCK = 1024
#: Rounds in which all blocks with another entry are parsed again; after them only the first such block of each text
#: is, so that texts whose parses never meet (long runs of one letter) take linear time too.
GUESSES = 4
MOST_LANGUAGES = 256
STATE_BITS = 24
LAST_STATE = (1 << STATE_BITS) - 1
#: Letters and spaces parsed together; bounds a worker's memory.
TOGETHER = 4 << 20


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 first (Blumer et al. 1985)."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@dataclass
class Parsers:
    """Automata of all languages, their states numbered in a row, in one hash table of transitions."""

    languages: list[str]
    weights: np.ndarray  # log2 of the training length
    roots: np.ndarray  # first state of each language
    first: np.ndarray  # states that each symbol leads to from the roots (rows: languages), the root itself if none
    table: np.ndarray  # key << STATE_BITS | next state, at one of the key's two slots; -1 in free ones
    alphabet: str  # symbol i + 2; 0 is the space, 1 any other letter

    @property
    def width(self) -> int:
        return len(self.alphabet) + 2

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States that the symbols lead to, -1 where none does."""
        keys = (states * self.width + symbols).ravel()
        one, two = (self.table[x] for x in _slots(keys, len(self.table)))
        hit = np.where(one >> STATE_BITS == keys, one, two)
        to = hit & LAST_STATE
        to[hit >> STATE_BITS != keys] = -1
        return to.reshape(states.shape)


def _slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each key in a table whose size is a power of two."""
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - size.bit_length() + 1)
    return (mixed >> shift).view(np.int64), ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> shift).view(np.int64)


def _cuckoo(entries: np.ndarray) -> np.ndarray:
    """A table of the entries, each at one of its key's two slots: a newcomer sends the entry there to its other one."""
    size = 1 << max((2 * len(entries)).bit_length(), 4)
    while True:
        table, left = np.full(size, -1, np.int64), entries
        at = _slots(left >> STATE_BITS, size)[0]
        for _ in range(200):
            slots, put = np.unique(at, return_index=True)
            out = table[slots]
            table[slots] = left[put]
            waiting = np.ones(len(left), bool)
            waiting[put] = False
            moved = out >= 0
            one, two = _slots(out[moved] >> STATE_BITS, size)
            left = np.concatenate([left[waiting], out[moved]])
            at = np.concatenate([at[waiting], np.where(slots[moved] == one, two, one)])
            if not len(left):
                return table
        size *= 2


def parsers_of(texts: dict[str, str]) -> Parsers:
    """Parsers from the training text of each language, made of lower-cased letters and single spaces."""
    alphabet = "".join(sorted({c for t in texts.values() for c in t} - {" "}))
    of = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": 0}
    width = len(alphabet) + 2
    keys, values, roots, at = [], [], [], 0
    first = np.zeros((len(texts), width), np.int64)
    for i, t in enumerate(texts.values()):
        moves = suffix_automaton([of[c] for c in t])
        first[i] = at
        for c, to in moves[0].items():
            first[i, c] = at + to
        keys += [(at + s) * width + c for s, out in enumerate(moves) for c in out]
        values += [at + to for out in moves for to in out.values()]
        roots.append(at)
        at += len(moves)
    if at > LAST_STATE or at * width >> (63 - STATE_BITS):
        raise ValueError("too many states: take fewer or shorter passages")
    table = _cuckoo(np.array(keys, np.int64) << STATE_BITS | np.array(values, np.int64))
    return Parsers(list(texts), np.array([math.log2(len(t) + 1) for t in texts.values()]), np.array(roots, np.int64), first, table, alphabet)


def _fold(c: str) -> str:
    """The lower-case letter, or a space for anything else."""
    if not c.isalpha():
        return " "
    low = c.lower()
    return low if len(low) == 1 else c


def _letters(text: str) -> str:
    return " ".join(x for x in "".join(map(_fold, text)).split(" ") if x)


def learn(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", id_col: str = "doc_id", train_rows: int = 80, passage: int = 200) -> Parsers:
    """Parsers from the usable rows that have a language and a text."""
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    # A language's least hashes hold at most train_rows passages of one text, so each text gives no more.
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / passage).cast("int"))
    least = F.slice(F.array_sort(F.transform(numbers, lambda k: F.struct(F.xxhash64("id", k).alias("u"), k.alias("k")))), 1, train_rows)
    # Passages are cut before they become rows of their own: no row carries its whole text along.
    cut = F.transform(least, lambda p: F.struct(p["u"].alias("u"), F.substring(F.col("text"), p["k"] * passage + 1, F.lit(passage)).alias("passage")))
    passages = known.select("lang", F.inline(cut))
    ranked = passages.withColumn("r", F.dense_rank().over(W.partitionBy("lang").orderBy("u", "passage"))).where(F.col("r") <= train_rows).select("lang", "r", "passage").distinct()
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in ranked.limit(MOST_LANGUAGES * train_rows + 1).collect():
        texts.setdefault(row["lang"], []).append((row["r"], _letters(row["passage"])))
    if sum(map(len, texts.values())) > MOST_LANGUAGES * train_rows or len(texts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return parsers_of({k: t for k in sorted(texts) if (t := " ".join(x for _, x in sorted(texts[k]) if x))})


def _encode(texts: pa.Array, of: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of spaces as one, and the bounds of each text."""
    raw = [x.encode("utf-32-le", "surrogatepass") for x in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
    points = np.frombuffer(b"".join(raw), np.uint32)
    table = np.zeros(0x110000, np.int32)
    table[points] = 1
    for c in np.flatnonzero(table).tolist():
        table[c] = of.get(_fold(chr(c)), 1)
    codes = table[points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    starts = bounds[:-1][bounds[:-1] < len(codes)]
    keep[starts] = codes[starts] != 0
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _parse(codes: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, parsers: Parsers) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each block begins in each language when entered in the given states, and the states it ends in."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # blocks longer than t
    counts, state = np.zeros(entry.shape, np.int32), entry[order]
    for t in range(int(length[0])):
        a = active[t]
        c = codes[start[:a] + t]
        to = parsers.follow(state[:a], c[:, None])
        again = parsers.first[:, c].T
        fresh = (to < 0) | (state[:a] == parsers.roots)
        counts[:a] += fresh
        # A symbol that no phrase starts with is a phrase of its own: it leads back to the root.
        state[:a] = np.where(fresh, again, to)
    back = np.argsort(order)
    return counts[back], state[back]


def phrase_counts(codes: np.ndarray, bounds: np.ndarray, parsers: Parsers) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), len(parsers.languages)), np.int64)
    blocks = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), blocks)
    if not len(row):
        return out
    nth = np.arange(len(row)) - (np.cumsum(blocks) - blocks)[row]
    start = bounds[:-1][row] + nth * BLOCK
    length = np.minimum(BLOCK, bounds[1:][row] - start)
    entry = np.tile(parsers.roots, (len(row), 1))
    counts, state = _parse(codes, start, length, entry, parsers)
    later, rounds = np.flatnonzero(nth), 0
    while len(wrong := later[(entry[later] != state[later - 1]).any(axis=1)]):
        rounds += 1
        if rounds > GUESSES:
            wrong = wrong[np.unique(row[wrong], return_index=True)[1]]
        entry[wrong] = state[wrong - 1]
        counts[wrong], state[wrong] = _parse(codes, start[wrong], length[wrong], entry[wrong], parsers)
    np.add.at(out, row, counts)
    return out


def predict(docs: DataFrame, parsers: Parsers, text: str = "text") -> DataFrame:
    """Add `lang_pred` (string) and `score` (double) to documents."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(parsers)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Parsers = shared.value
        of = {c: i + 2 for i, c in enumerate(model.alphabet)} | {" ": 0}
        for batch in batches:
            names, scores = [], []
            texts = pc.fill_null(batch.column(at), "")
            weight = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
            first = 0
            while first < len(texts):
                last = max(int(np.searchsorted(weight, weight[first] + TOGETHER, side="right")) - 1, first + 1)
                codes, bounds = _encode(texts.slice(first, last - first), of)
                sizes = np.diff(bounds)
                if model.languages:
                    rate = phrase_counts(codes, bounds, model) * model.weights / np.maximum(sizes, 1)[:, None]
                    order = np.argsort(rate, axis=1, kind="stable")
                    best = np.take_along_axis(rate, order[:, :1], 1)[:, 0]
                    second = np.take_along_axis(rate, order[:, 1:2], 1)[:, 0] if len(model.languages) > 1 else np.full(len(sizes), np.inf)
                    sure = np.where(np.isinf(second), 1.0, 1 - best / np.maximum(second, 1e-12))
                    names += [model.languages[i] if n else UNKNOWN for i, n in zip(order[:, 0].tolist(), sizes.tolist(), strict=True)]
                    scores += np.where(sizes > 0, np.clip(sure, 0, 1), 0.0).tolist()
                else:
                    names += [UNKNOWN] * len(sizes)
                    scores += [0.0] * len(sizes)
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
