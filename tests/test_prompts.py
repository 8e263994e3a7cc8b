"""Prompts by batch, typed ids, one call a batch over all outputs, throughput."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foliomill.operators import enrich as E
from foliomill.operators import pipelines as J

CACHE = "source_hash string, translated_text string, status string"


def test_terms_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "en", "The cat sat; the CATS, New York Times"), (2, "en", ""), (3, "fr", "cat"), (4, "en", None), (5, "en", "naïve_x naïve")], "id int, lang string, text string")
    terms = spark.createDataFrame([("en", "cat", "A"), ("en", "cat", "A"), ("en", "cat sat the", "B"), ("en", "York Times now", "C"), ("en", "New York", "D"), ("en", "--", "E"), ("en", "naïve", "F"), ("en", "", "G")], "lang string, term string, translation string")
    got = sorted(tuple(r) for r in E.terms_in(texts, terms, "lang", ["id"]).collect())
    assert got == [(1, "New York", "D"), (1, "cat", "A"), (1, "cat sat the", "B"), (5, "naïve", "F")]
    assert E.terms_in(texts, terms.limit(0), "lang", ["id"]).count() == 0


def test_a_prompt_for_each_batch(spark):
    class Echo:
        def one(self, prompt, text):
            return prompt

        def batch(self, prompt, items):
            return json.dumps([{"id": i, "translation": prompt} for i, _ in items])

    items = spark.createDataFrame([(1, f"i{k:02d}", k, "known" if k == 7 else f"text {k} word{k // 8}") for k in range(16)], "job_id long, id string, n int, text string")
    cache = spark.createDataFrame([("zh " * 400, "completed", "known")], "translated_text string, status string, text string").withColumn("source_hash", F.md5("text"))
    terms = spark.createDataFrame([(1, "word1", "W"), (1, "text", "T"), (2, "word0", "other book")], "job_id long, term string, translation string")
    got = {r.id: r.translation for r in E.translate(items, cache, lambda: Echo(), ["n"], "Go.", terms).collect()}
    assert got["i00"] == "Go.\n\nGlossary:\ntext → T"
    assert got["i08"] == "Go.\n\nGlossary:\ntext → T\nword1 → W\n\nContext:\n" + ("zh " * 400)[:500] and got["i07"] == "zh " * 400


@pytest.mark.parametrize("kind,shown,done", [("string", "str", True), ("string", "int", False), ("long", "int", True), ("long", "str", False)])
def test_ids_keep_their_type(spark, kind, shown, done):
    class Typed:
        def one(self, prompt, text):
            raise ValueError("not asked alone")

        def batch(self, prompt, items):
            cast = str if shown == "str" else int
            return json.dumps([{"id": cast(i), "translation": "t"} for i, _ in items])

    items = spark.createDataFrame([(1, "1", 0, "x")], "job_id long, id string, n int, text string").withColumn("id", F.col("id").cast(kind))
    row = E.translate(items, spark.createDataFrame([], CACHE), lambda: Typed(), ["n"]).first()
    assert (row.translation, row.status) == (("t", "completed") if done else ("", "failed"))
    reply = spark.createDataFrame([('[{"id": 1, "translation": "n"}, {"id": "1", "translation": "s"}, {"translation": "no id"}]',)], "reply string")
    assert [tuple(r) for r in E.parse_replies(reply, id_type=kind).select("id", "translation").collect()] == [("1", "s") if kind == "string" else (1, "n")]


def test_calls_equal_batches_over_all_outputs(spark, tmp_path):
    path = str(tmp_path / "calls")

    class Counting:
        def one(self, prompt, text):
            raise ValueError("not asked alone")

        def batch(self, prompt, items):
            with open(path, "a") as f:
                f.write(f"{len(items)}\n")
            return json.dumps([{"id": i, "translation": f"<{t}>"} for i, t in items])

    rows = [(f"c{k % 2}", f"p{k:02d}", k, f"text {k}", "", "", "failed" if k % 5 == 0 else "pending" if k % 2 else "completed") for k in range(40)]
    paras = spark.createDataFrame(rows, "chapter_id string, paragraph_id string, paragraph_order int, text string, translation string, error_message string, status string")
    done = J.translate_chapters(paras, spark.createDataFrame([], CACHE), lambda: Counting(), statuses=("pending", "failed"))
    for frame in done.values():
        frame.collect()
    waiting = [r for r in rows if r[6] != "completed"]
    calls = [int(x) for x in open(path).read().split()]
    assert sum(calls) == len(waiting) and len(calls) == sum(-(-sum(r[0] == c for r in waiting) // 8) for c in ("c0", "c1"))
    assert done["paragraphs"].where("status <> 'completed'").count() == 0
    assert J.pending_items(paras).count() == sum(r[6] == "pending" for r in rows)


def test_observed_totals_equal_the_aggregate(spark):
    items = spark.createDataFrame([(1, f"i{k}", k, "" if k == 3 else f"t{k % 9}") for k in range(20)], "job_id long, id string, n int, text string")

    class Same:
        def one(self, prompt, text):
            return text

        def batch(self, prompt, items):
            return json.dumps([{"id": i, "translation": t} for i, t in items])

    results, seen = E.observed(E.translate(items, spark.createDataFrame([], CACHE), lambda: Same(), ["n"]))
    rows = results.collect()
    assert seen.get == {"total": 20, "completed": sum(r.status == "completed" for r in rows), "failed": sum(r.status == "failed" for r in rows), "hits": sum(r.cached for r in rows)}
    assert seen.get["hits"] > 0 and seen.get["failed"] == 1


def test_one_text():
    class Upper:
        def one(self, prompt, text):
            if text == "boom":
                raise ValueError("no" * 400)
            return f" {text.upper()} "

    assert E.translate_one("a", Upper()) == ("A", None) and E.translate_one(" ", Upper()) == ("", None)
    assert E.translate_one("boom", Upper()) == ("", ("no" * 400)[:500])
