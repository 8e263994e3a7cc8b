from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.operators import enrich as E
from foliomill.operators import migrate as M
from foliomill.operators import reader as R
from foliomill.operators import store as T
from foliomill.sources import html_blocks as H
from foliomill.sources.tables import Table, TableSet
from foliomill.streaming import progress as G


def make_provider():
    """A class that is pickled with the tasks, since workers cannot import this file."""

    class Provider:
        def one(self, prompt, text):
            if "boom" in text:
                raise ValueError("x" * 600)
            return f" <{text}> "

        def batch(self, prompt, items):
            if any("broken" in t for _, t in items):
                return "no json"
            return "```json\n" + json.dumps([{"id": i, "translation": f"<{t}>"} for i, t in items if "gone" not in t] + [{"id": "other", "translation": "?"}]) + "\n```"

    return Provider


def test_translate(spark):
    texts = ["a", "a", " ", "gone", "b", "c", "d", "e", "a", "broken", "boom", "known"]
    items = spark.createDataFrame([(1, f"i{k:02d}", k, t) for k, t in enumerate(texts)], "job_id long, id string, n int, text string")
    cache = spark.createDataFrame([("known", "<old>", "completed"), ("b", "<never>", "failed")], "text string, translated_text string, status string").withColumn("source_hash", F.md5("text"))
    got = E.translate(items, cache, make_provider(), ["n"]).orderBy("id").collect()
    assert [r.translation for r in got] == ["<a>", "<a>", "", "", "<b>", "<c>", "<d>", "<e>", "<a>", "<broken>", "", "<old>"]
    assert [r.cached for r in got] == [False] * 8 + [True, False, False, True]
    assert [r.status for r in got] == ["completed", "completed", "failed", "failed", *["completed"] * 6, "failed", "completed"]
    assert got[2].message == E.EMPTY and got[3].message == E.MISSING and len(got[10].message) == 500


def test_each_batch_is_asked_once(spark, tmp_path):
    path = str(tmp_path / "calls")

    class Counting:
        def one(self, prompt, text):
            raise ValueError("no item is asked alone")

        def batch(self, prompt, items):
            with open(path, "a") as f:
                f.write(f"{len(items)}\n")
            return json.dumps([{"id": i, "translation": f"<{t}>"} for i, t in items])

    items = spark.createDataFrame([(j, f"i{j}-{k:02d}", k, f"text {j} {k % 30}") for j in range(3) for k in range(40)], "job_id long, id string, n int, text string")
    cache = spark.createDataFrame([], "source_hash string, translated_text string, status string")
    got = E.translate(items, cache, lambda: Counting(), ["n"]).collect()
    assert len(got) == 120 and all(r.status == "completed" for r in got)
    calls = [int(x) for x in open(path).read().split()]
    assert len(calls) == 3 * 4 and max(calls) <= 8 and sum(calls) == 90


def test_cache_rows_and_rollups(spark):
    rows = spark.createDataFrame([(1, "completed"), (1, "completed"), (2, "failed"), (2, "failed"), (3, "completed"), (3, "pending")], "job_id long, status string")
    got = E.status_counts(rows, ["job_id"]).withColumns({"j": E.job_status(), "c": E.chapter_status()}).orderBy("job_id").collect()
    assert [(r.j, r.c) for r in got] == [("completed", "completed"), ("failed", "partial"), ("partial", "partial")]


def test_prompt(spark):
    df = spark.createDataFrame([(["a → b"], "c" * 600), ([], "")], "g array<string>, c string")
    long, short = [r[0] for r in df.select(E.build_prompt(F.lit("P"), F.col("g"), F.col("c"))).collect()]
    assert long == "P\n\nGlossary:\na → b\n\nContext:\n" + "c" * 500 and short == "P"


def test_matches(spark):
    new = spark.createDataFrame([(1, 0, 1, "the quick brown fox"), (1, 1, 5, "the quick brown fox"), (1, 2, 1, "unlike all"), (1, 3, 1, "!!")], "book_id long, new_id int, page_number int, text string")
    old = spark.createDataFrame(
        [(1, 0, 0, 0, "the quick brown fox", "zero"), (1, 1, 1, 1, "the quick brown fix", "near"), (1, 2, 2, 2, "the quick brown fox", "exact"), (1, 3, 3, 3, "the quick brown fox", "later"), (1, 4, 4, 2, "??", "")],
        "book_id long, old_id int, old_order int, page_number int, old_text string, translation string",
    )
    got = M.best_matches(new, old).orderBy("new_id").collect()
    assert [(r.old_id, r.status) for r in got] == [(2, "completed"), (2, "completed"), (None, "pending"), (4, "pending")]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, ver int")
    assert sorted((r.k, r.v) for r in T.upsert(old, new, ["k"], "ver").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r.parse_status for r in T.recover_crashed(spark.createDataFrame([("parsing",), ("completed",)], "parse_status string")).collect()] == ["failed", "completed"]


def test_reader_bounds(spark):
    for offset, limit in ((-1, 5), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            R.check_page(offset, limit)
    df = spark.createDataFrame([(0, 3), (2, None), (None, 0)], "a int, b int")
    assert [r[0] for r in df.select(R.positive(F.col("a"), F.col("b"), 0)).collect()] == [3, 2, 0]


def test_ingest(spark):
    files = spark.createDataFrame([("/in/A.PDF",), ("/in/b.epub",), ("/in/c.txt",)], "path string").withColumn("modificationTime", F.timestamp_seconds(F.lit(0)))
    assert sorted((r.title, r.format) for r in T.ingest(files).collect()) == [("A.PDF", "pdf"), ("b.epub", "epub")]


def test_html_blocks(spark):
    source = """<body><nav><p>no</p></nav><h2 id="t">T &amp; <i>x</i></h2><div><p>a <a id="k"></a><img src="i.png" alt="pic"> b</p><p><a id="e"></a> </p><blockquote>q</blockquote></div>
      <table><tr><td>dropped</td></tr></table><ul><li>one<ul><li>two</li></ul></li></ul><figure><img src="f.png"></figure><p>un<p>closed</body>"""
    blocks, anchors = H.blocks_of(source)
    assert [(b[0].strip(), b[1], b[2]) for b in blocks][:5] == [("T & x", "heading", 2), ("a  b", "paragraph", None), ("pic", "image", None), ("q", "quote", None), ("onetwo", "list_item", None)]
    assert anchors == {"k": 1, "e": 3}
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "id long, html string")
    assert [r.type for r in H.blocks(df, "id").orderBy("seq").collect()] == ["heading", "paragraph", "image", "quote", "list_item", "image", "paragraph"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "completed", 0), (1, "failed", 5), (2, "pending", 9)], "job_id long, status string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = G.drain_complete(G.job_progress(stream), str(tmp_path / "drained"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.job_progress(rows).collect()))


def test_translation_stream_resumes_with_its_own_cache(spark, tmp_path):
    schema = "job_id long, id string, paragraph_order int, text string"
    empty = spark.createDataFrame([], "source_hash string, translated_text string, status string")
    for name, rows in (("x", [(1, "a", 0, "one"), (1, "b", 1, "boom")]), ("y", [(1, "c", 2, "one"), (1, "d", 3, "two")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        G.translate_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), make_provider(), empty).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "results")).orderBy("id").collect()
    assert [(r.id, r.cached, r.status) for r in got] == [("a", False, "completed"), ("b", False, "completed"), ("c", True, "completed"), ("d", False, "completed")]
    # Later epochs read their buckets only: the cache has one row for each text, and no epoch's results are read again.
    store = TableSet(spark, str(tmp_path / "out" / "cache"), [G.CACHE])
    assert sorted(r.translated_text for r in store.read("cache").collect()) == ["<boom>", "<one>", "<two>"] and len(store.versions()) == 2


def test_a_file_uploaded_twice_is_one_book(spark, tmp_path):
    books = Table("books", StructType.fromDDL("book_id string, title string, format string, file_path string, parse_status string, uploaded_at string"), ("book_id",), 2)
    store, folder = TableSet(spark, str(tmp_path / "set"), [books]), tmp_path / "in"
    folder.mkdir()

    def run():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(folder))
        G.ingest_stream(files.select("path", "modificationTime", "content"), store, "books", str(tmp_path / "check")).awaitTermination()

    for name, text in (("a.epub", "one"), ("b.epub", "one"), ("c.pdf", "two"), ("d.txt", "three")):
        (folder / name).write_text(text)
    run()
    with store.transaction() as tx:
        tx.upsert("books", store.read("books").withColumn("parse_status", F.lit("completed")))
    (folder / "e.epub").write_text("one")
    (folder / "f.epub").write_text("four")
    run()
    got = sorted((r.format, r.parse_status) for r in store.read("books").collect())
    assert got == [("epub", "completed"), ("epub", "pending"), ("pdf", "completed")]
