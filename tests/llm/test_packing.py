"""Packing: places fit, nothing is lost, few sequences, ids as `tokenizers` gives them, choices as a plain model makes them."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliomill.llm import packing, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def expected(doc_id, text, encode, capacity):
    ids = [*encode(text or ""), 0]
    head = len(ids) % capacity if len(ids) > capacity else len(ids)
    cuts = sorted({0, *range(head, len(ids) + 1, capacity)} | {len(ids)})
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_places(rows, capacity):
    """Sequences are filled from 0 on without gaps; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sdA1.é漢　\x85<|>", max_size=60))
def test_ids_are_those_of_the_file(text):
    t = Tokenizer.from_file(FILE) if not hasattr(test_ids_are_those_of_the_file, "t") else test_ids_are_those_of_the_file.t
    test_ids_are_those_of_the_file.t = t
    t.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encoder(FILE)([text]) == [t.encode(text, add_special_tokens=False).ids]


def test_other_files_are_left_to_the_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(other)
    assert packing.encoder(other)(["Hello there"]) == [t.encode("Hello there", add_special_tokens=False).ids]


def test_packer_makes_the_choice_of_a_plain_model():
    random.seed(5)
    for reluctant in (False, True):
        capacity = 12
        packer, bins = packing.Packer(capacity, reluctant), []

        def squares(fills):
            counts = defaultdict(int)
            for f in fills:
                counts[capacity - f] += f < capacity
            return sum(c * c for c in counts.values())

        for _ in range(300):
            size = random.randint(1, capacity - 1)
            fits = {}
            for k, f in enumerate(bins):
                if f + size <= capacity and f < capacity:
                    fits.setdefault(squares([*bins[:k], f + size, *bins[k + 1 :]]), k)
            opened = squares([*bins, size])
            sequence, offset = packer.place(size)
            if sequence == len(bins):
                assert offset == 0 and not (fits and (reluctant or min(fits) <= opened))
                bins.append(size)
            else:
                assert offset == bins[sequence]
                bins[sequence] += size
                assert squares(bins) == min(fits) and (reluctant or min(fits) <= opened)


@pytest.mark.parametrize("group", [512, 1 << 16])
def test_pack_keeps_all_and_wastes_little(spark, group):
    random.seed(2)
    sizes = [min(int(random.expovariate(1 / 300)) + 1, 2048) for _ in range(3000)]
    rows = spark.createDataFrame([(i, s, "old", None) for i, s in enumerate(sizes)], "id int, length long, offset string, sequence_id int").repartition(3)
    got = packing.pack(rows, 2048, group).collect()
    assert sorted((r.id, r.length) for r in got) == list(enumerate(sizes))
    assert check_places(got, 2048) <= sum(sizes) // 2048 + 4


def test_pieces_that_never_fit_together(spark):
    rows = spark.range(500).selectExpr("id", "1500L AS length")
    assert check_places(packing.pack(rows, 2048, 64).collect(), 2048) == 500
    assert packing.pack(rows.limit(0), 2048).count() == 0


def test_odd_documents(spark, reference):
    rows = [(1, None, 9), (None, "", 9), (2, "two words", 9), (2, "two words", 9), (3, "long text " * 5000, 9), (4, " a" * 63, 9), (5, " a" * 127, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    pieces = packing.token_pieces(docs, FILE, 64, keep_ids=True)
    got = packing.pack(pieces, 64).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted((p for i, text, _ in rows for p in expected(i, text, reference, 64)), key=key)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == want
    assert check_places(got, 64) == -(-sum(r.length for r in got) // 64)
    whole = packing.sequences(packing.pack(pieces, 64)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got) and max(len(r.ids) for r in whole) == 64
    assert packing.token_pieces(docs.limit(0), FILE, 64).count() == 0


def test_query(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_pack_sequences(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(p for d in docs for p in expected(*d, reference, 2048))
    assert check_places(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 2
