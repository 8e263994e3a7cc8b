"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import models as m
from pyspark.sql import functions as F

from foliomill.llm import periodic_runs, queries


def plain_runs(words, min_length):
    found, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            part = words[s : i + p]
            if len(part) >= max(min_length, 2 * p) and not any(part[:-q] == part[q:] for q in range(1, p)):
                found.append((s, len(part), p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_row(doc_id, text):
    words = m.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapse(words, runs)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=50), st.integers(1, 6), st.integers(2, 14))
def test_runs_equal_a_plain_search(letters, times, min_length):
    words = [c.encode() for c in (letters * times)[:90]]
    assert [tuple(r) for r in periodic_runs.find_runs_of(words, min_length).tolist()] == plain_runs(words, min_length)


def test_lyndon_lengths():
    random.seed(3)
    for _ in range(200):
        w = [random.randint(1, 3) for _ in range(random.randint(1, 25))]
        ranks = [0, *w, 0]
        want = []
        for i in range(len(w)):
            lyndon = [k for k in range(1, len(w) - i + 1) if all(w[i : i + k] < w[i + j : i + k] for j in range(1, k))]
            want.append(max(lyndon))
        assert periodic_runs.lyndon_lengths(ranks)[1:-1] == want


def test_a_false_hash_is_found_out():
    import numpy as np

    assert periodic_runs.holds(np.array([1, 2, 1, 2]), np.array([[0, 4, 2]]))
    assert not periodic_runs.holds(np.array([1, 2, 1, 3]), np.array([[0, 4, 2]]))


def test_operator_on_odd_rows(spark):
    rows = [(1, None, 5), (None, "", 5), (2, " \n\t", 5), (3, "la " * 50, 5), (3, "la " * 50, 5), (4, "x y z " * 100_000, 5), (5, "é\x0bé " * 8 + " end", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted(periodic_runs.find_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 50, [(0, 50, 1)], "la"),
        (3, 50, [(0, 50, 1)], "la"),
        (4, 300_000, [(0, 300_000, 3)], "x y z"),
        (5, 17, [(0, 16, 1)], "é  end"),
        (None, 0, [], ""),
    ]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, 1)


def test_query_equals_plain_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000).collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert {r.doc_id: got[r.doc_id] for r in docs} == {r.doc_id: plain_row(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in got.values()) > len(got) // 20
