"""Tables that change by commits: what is written, what a failure leaves, conflicts, cascades, streams."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from foliomill.operators import library as Y
from foliomill.sources import tables as T
from foliomill.streaming import progress as G

PAGES = "book_id long, page int, version int, text string"


@pytest.fixture
def store(spark, tmp_path):
    schema = StructType.fromDDL
    tables = [
        T.Table("books", schema("book_id long, title string"), ("book_id",), 4),
        T.Table("pages", schema(PAGES), ("book_id", "page"), 8, {"book_id": ("books", "book_id")}),
        T.Table("notes", schema("note string, page int"), ("note",), 2, {"page": ("pages", "page")}),
    ]
    made = T.TableSet(spark, str(tmp_path / "set"), tables)
    with made.transaction() as tx:
        tx.upsert("books", spark.range(5).selectExpr("id AS book_id", "'t' AS title"))
        tx.upsert("pages", spark.range(50).selectExpr("id % 5 AS book_id", "id div 5 AS page", "1 AS version", "'a' AS text"), "version")
    return made


def rows(spark, *values):
    return spark.createDataFrame(list(values), PAGES)


def test_only_buckets_touched_are_written(spark, store):
    with store.transaction() as tx:
        tx.upsert("pages", rows(spark, (1, 1, 2, "b"), (1, 1, 3, "c"), (1, 1, 3, "b")), "version")
    assert len(tx.written) == 1 and tx.written[0].startswith("data/pages/")
    own = store.read("pages").where("book_id = 1 AND page = 1").collect()
    assert [tuple(r) for r in own] == [(1, 1, 3, "c")] and store.read("pages").count() == 50
    assert store.read("pages", version=1).where("version > 1").count() == 0


def test_null_keys_missing_columns_and_empty_changes(spark, store):
    with store.transaction() as tx:
        tx.upsert("pages", rows(spark, (None, None, 1, "x"), (None, None, 1, "y")).drop("version"))
        tx.upsert("pages", rows(spark).limit(0))
        tx.delete("books", spark.createDataFrame([(99,), (None,)], "book_id long"))
    assert [tuple(r) for r in store.read("pages").where("book_id IS NULL").collect()] == [(None, None, None, "y")]
    assert store.read("books").count() == 5 and store.read("notes").count() == 0


def test_a_failure_half_way_shows_the_old_state(spark, store):
    before = store.versions()
    with pytest.raises(ZeroDivisionError), store.transaction() as tx:
        tx.delete("books", spark.createDataFrame([(1,)], "book_id long"))
        tx.upsert("books", spark.createDataFrame([(7, "new")], "book_id long, title string"))
        1 / 0
    assert store.versions() == before and store.read("books").count() == 5 and store.read("pages").count() == 50
    left = store.expire(keep=1, older_than_ms=0)
    assert left and store.read("pages").count() == 50 and store.read("books").count() == 5


def test_the_second_of_two_writers_is_refused(spark, store):
    one, two = store.transaction(), store.transaction()
    one.upsert("books", spark.createDataFrame([(8, "one")], "book_id long, title string"))
    two.upsert("books", spark.createDataFrame([(8, "two")], "book_id long, title string"))
    one.commit()
    with pytest.raises(T.Conflict):
        two.commit()
    assert store.read("books").where("book_id = 8").first().title == "one"
    assert not [n for n in store._names("manifests") if n.startswith(".draft")]


def test_deletes_follow_references(spark, store):
    with store.transaction() as tx:
        tx.upsert("notes", spark.createDataFrame([("n0", 0), ("n77", 77)], "note string, page int"))
    with store.transaction() as tx:
        tx.delete("books", spark.createDataFrame([(2,), (2,)], "book_id long"))
    assert (store.read("books").count(), store.read("pages").count()) == (4, 40)
    assert [r.note for r in store.read("notes").collect()] == ["n77"]
    with store.transaction() as tx:
        tx.delete("books", spark.createDataFrame([(3,)], "book_id long"), spare=("pages",))
    assert (store.read("books").count(), store.read("pages").count()) == (3, 40)
    removed = store.expire(keep=1, older_than_ms=0)
    assert removed and len(store.versions()) == 1 and store.read("pages").count() == 40


def test_a_stream_killed_between_write_and_commit(spark, store, tmp_path):
    put = lambda name, *values: rows(spark, *values).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    check = str(tmp_path / "check")

    def start():
        stream = spark.readStream.schema(PAGES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return G.upsert_pages(stream, store, "pages", check, "version")

    put("x", (1, 1, 2, "b"), (6, 1, 1, "new"))
    start().awaitTermination()
    put("y", (1, 1, 3, "c"))
    publish, store._publish = store._publish, lambda manifest: 1 / 0  # dies after the folders are written
    with pytest.raises(Exception, match="ZeroDivisionError"):
        start().awaitTermination()
    assert store.read("pages").where("book_id = 1 AND page = 1").first().text == "b"
    store._publish = publish
    start().awaitTermination()
    assert store.read("pages").where("book_id = 1 AND page = 1").first().text == "c"
    versions = store.versions()
    # Dies after the commit, before Spark notes the batch as done: it runs again and changes nothing.
    last = max((p for p in Path(check, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    start().awaitTermination()
    assert store.versions() == versions and store.read("pages").count() == 51


def test_structure_is_replaced_whole(spark, tmp_path):
    store = Y.library(spark, str(tmp_path / "lib"), buckets=2)
    with store.transaction() as tx:
        tx.upsert("books", spark.createDataFrame([(1, "t"), (2, "u")], "book_id long, title string"))
        tx.upsert("assets", spark.createDataFrame([(1, "a.png"), (2, "b.png")], "book_id long, name string"))
    chapters = spark.createDataFrame([(1, 0, "A", 2), (1, 1, "B", 0)], "book_id long, chapter_order int, title string, paragraph_count int")
    paras = spark.createDataFrame([(1, 0, 0, 0, "one", 1, 1, 0.5), (1, 0, 1, 1, "two", 1, 2, 0.5)], "book_id long, chapter_order int, paragraph_order int, para_idx int, text string, page_number int, page_end int, confidence double")
    frags = spark.createDataFrame([(1, 0, 0, 1, "one"), (1, 1, 0, 2, "two")], "book_id long, para_idx int, fragment_order int, pdf_page_number int, source_text string")
    counts = lambda: {n: store.read(n).count() for n in ("chapters", "paragraphs", "fragments", "jobs")}
    for _ in range(2):
        with store.transaction() as tx:
            Y.insert_structure(tx, chapters, paras, frags)
        assert counts() == {"chapters": 2, "paragraphs": 2, "fragments": 2, "jobs": 1}
    with store.transaction() as tx:
        Y.insert_structure(tx, chapters.where("chapter_order = 1"), paras.limit(0), frags.limit(0))
    assert counts() == {"chapters": 1, "paragraphs": 0, "fragments": 0, "jobs": 0}
    assert sorted(r.parse_status or "" for r in store.read("books").collect()) == ["", "completed"]
    files = Y.delete_books(store, spark.createDataFrame([(1,), (9,)], "book_id long")).collect()
    assert [tuple(r) for r in files] == [(1, "a.png")] and counts()["chapters"] == 0
    assert [r.book_id for r in store.read("books").collect()] == [2] and store.read("assets").count() == 1
