r"""Benchmark decontamination with an Aho-Corasick automaton.

Every item is cut into windows of `window` consecutive normalised words (an item of fewer words is one
window). All windows form one automaton, against which each whole document text is scanned once; matches
are mapped back to the words, and the characters, of the original text.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A normalised text is
" w1 w2 ... ", so a window, with a space at both ends, matches at word boundaries only.

The items reach executors as broadcast blocks of at most `BLOCK_WINDOWS` windows. More items than that make
more blocks, scanned one after another in the same pass over the documents, so no broadcast grows with the
benchmark and no item is left out.

Defined results: null texts have no words; items without words are ignored; items without an id are one item, whose id
is the empty text; rows that repeat an item's id belong to it; equal windows of several items count for each of them;
equal rows give equal results; empty tables give no hits; long texts are scanned whole, in memory that grows with the
longest of them; columns named `n_words`, `hits` or `item_ids` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WINDOWS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: ASCII to itself if it belongs to a word, A-Z to a-z, all else to a space.
_FOLD = {c: chr(c) if 48 <= c <= 57 or 97 <= c <= 122 else chr(c + 32) if 65 <= c <= 90 else " " for c in range(128)}
_HITS = "array<struct<start:int,length:int,from_char:int,to_char:int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_UPPER))


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (window, item id) in the order of the items; the driver holds one block at a time."""
    block: list[tuple[str, str]] = []
    for item, text in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        words = words_of(text)
        for i in range(max(len(words) - window, 0) + 1) if words else ():
            block.append((" " + " ".join(words[i : i + window]) + " ", item))
            if len(block) >= block_windows:
                yield block
                block = []
    if block:
        yield block


def _build(block: list[tuple[str, str]]):
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for window, item in block:
        owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, own in owners.items():
        automaton.add_word(window, (window.count(" ") - 1, own))
    automaton.make_automaton()
    return automaton


def _scan(text: str, automaton) -> tuple[int, dict[int, int], set[str]]:
    """Number of words; start word -> words for the longest window that starts there; ids found."""
    words = [w for w in text.translate(_FOLD).split(" ") if w]
    flat = f" {' '.join(words)} "
    hits: dict[int, int] = {}
    found: set[str] = set()
    at, seen = 0, 0
    for end, (length, own) in automaton.iter(flat):
        seen += flat.count(" ", at, end)
        at = end
        start = seen - length
        hits[start] = max(hits.get(start, 0), length)
        found.update(own)
    return len(words), hits, found


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id", item_text: str = "text", text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add `n_words` (long), `hits` and `item_ids` (sorted strings).

    `hits` holds merged, sorted runs of words (start, length) with their places in the original text: characters from
    `from_char` up to `to_char`, which is not included.
    """
    spark = docs.sparkSession
    own = docs.drop("n_words", "hits", "item_ids")
    out = own.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(_HITS), "item_ids": F.lit(None).cast("array<string>")})
    blocks = 0
    for block in item_blocks(items, item_id, item_text, window, block_windows):
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), text), out.schema)
        blocks += 1
    return out if blocks else out.mapInArrow(_scanner(None, text), out.schema)


def _scanner(shared, text_col: str):

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _build(shared.value) if shared else None
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col))
            old_hits, old_ids = batch.column(names.index("hits")), batch.column(names.index("item_ids"))
            counts, hits, ids = [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                if automaton is None:
                    n, starts, found = len(words_of(text)), {}, set()
                else:
                    n, starts, found = _scan(text, automaton)
                runs = [(h["start"], h["length"]) for h in old_hits[i].as_py() or ()]
                counts.append(n)
                merged = [(s, e - s) for s, e in _merged(runs + list(starts.items()))]
                places = original_spans(text, merged) if merged else []
                hits.append([{"start": s, "length": n, "from_char": a, "to_char": b} for (s, n), (a, b) in zip(merged, places, strict=True)])
                ids.append(sorted(found.union(old_ids[i].as_py() or ())))
            put = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type), "item_ids": pa.array(ids, batch.schema.field("item_ids").type)}
            yield pa.RecordBatch.from_arrays([put.get(n, batch.column(j)) for j, n in enumerate(names)], schema=pa.schema([batch.schema.field(n) for n in names]))

    return scan


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, length in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(s, e) for s, e in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text for runs of words (start, length)."""
    places = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
    return [(places[s][0], places[s + n - 1][1]) for s, n in runs]


def n_hit_words() -> Column:
    """Words of a row that lie inside its hits."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["length"])
