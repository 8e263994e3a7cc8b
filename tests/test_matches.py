"""Re-matching of translations: bounds never lose the best pair, and few pairs are compared."""

from __future__ import annotations

from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions.text import normalise_for_match
from foliomill.operators import migrate as M
from foliomill.plans import enrichment


def plain_best(pairs):
    """Compare every candidate of every new paragraph; the best of at least the threshold, of equal ones the first."""
    best = {}
    for r in sorted(pairs, key=lambda r: (r.tier, r.old_page, r.old_order, r.old_id)):
        ratio = SequenceMatcher(None, r.a, r.b).ratio() if r.a or r.b else 1.0
        if ratio >= M.ACCEPT and ratio > best.get((r.book_id, r.new_id), (None, 0.0))[1]:
            best[r.book_id, r.new_id] = (r.old_id, ratio)
    return best


def compare_all(new, old):
    pairs = M.candidates(new.where("text <> ''"), old.where("old_text <> ''")).withColumns({"a": normalise_for_match(F.col("text")), "b": normalise_for_match(F.col("old_text"))})
    return plain_best(pairs.collect())


@settings(max_examples=200, deadline=None)
@given(st.text("abeéz -", max_size=30), st.text("abeéz -", max_size=30))
def test_the_bound_holds(a, b):
    signs = lambda t: [t.count(c) for c in M.SIGNS] + [sum(c not in M.SIGNS for c in t)]
    common = sum(map(min, signs(a), signs(b)))
    assert SequenceMatcher(None, a, b).ratio() <= (2 * common / (len(a) + len(b)) if a or b else 1.0) + 1e-12


def test_bound_columns(spark):
    df = spark.createDataFrame([("hello there", "other théré"), ("", ""), ("abc", "xyz")], "a string, b string")
    got = df.select(M.ratio_bound(M.sign_counts(F.col("a")), M.sign_counts(F.col("b"))).alias("x")).collect()
    assert [round(r.x, 6) for r in got] == [round(2 * 7 / 22, 6), 1.0, 0.0]


def test_all_documents_as_if_all_were_compared(spark, sf_dir):
    new, old = (df.cache() for df in enrichment._old_new(spark, sf_dir))
    got = {(r.book_id, r.new_id): (r.old_id, r.similarity) for r in M.best_matches(new, old).collect() if r.similarity}
    assert got == compare_all(new, old)
    pairs = M.prepared_pairs(new, old)
    compared = M.compared_matches(pairs, new, old).agg(F.sum("compared")).first()[0] or 0
    assert compared < 0.05 * pairs.count()


def test_edits_ties_and_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from home"
    new = [(1, 1, 3, base), (1, 2, 3, base.replace("quick", "quack")), (1, 3, 9, "nothing alike at all"), (1, 4, 3, ""), (1, 5, 3, "--"), (2, 1, 1, base), (None, 1, 1, base)]
    old = [(1, 10, 0, 4, base, "far"), (1, 11, 1, 3, base, "zh"), (1, 12, 2, 3, base, "later"), (1, 13, 3, 3, base.replace("quick", "quirk"), ""), (1, 14, 4, 3, "‐", "dash"), (2, 20, 0, 9, base, "too far"), (1, 15, 5, 0, base, "page 0")]
    new = spark.createDataFrame(new, "book_id long, new_id int, page_number int, text string")
    old = spark.createDataFrame(old, "book_id long, old_id int, old_order int, page_number int, old_text string, translation string")
    got = {(r.book_id, r.new_id): (r.old_id, r.similarity) for r in M.best_matches(new, old).collect()}
    want = compare_all(new, old)
    assert {k: v for k, v in got.items() if v[0] is not None} == want and len(got) == 7
    assert got[1, 1] == (11, 1.0) and got[1, 5] == (14, 1.0) and got[2, 1] == (None, 0.0)
    assert M.best_matches(new.limit(0), old).count() == 0 and M.best_matches(new, old.limit(0)).count() == 7
