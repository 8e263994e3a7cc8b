"""Books with all that hangs on them, as one set of tables: inserted, parsed again and deleted in one commit each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.sources.tables import Table, TableSet, Transaction

_COLUMNS = {
    "books": "book_id long, title string, parse_status string, total_chapters int",
    "pages": "book_id long, page_number int, status string, version int, raw_text string",
    "assets": "book_id long, name string",
    "chapters": "chapter_id string, book_id long, chapter_order int, title string, paragraph_count int, translate_status string",
    "paragraphs": "paragraph_id string, chapter_id string, paragraph_order int, source_text string, page_number int, page_end int, confidence double, status string",
    "fragments": "paragraph_id string, fragment_order int, page_number int, x1 double, y1 double, x2 double, y2 double, source_text string",
    "translations": "paragraph_id string, source_hash string, translated_text string, status string",
    "jobs": "job_id string, chapter_id string, status string, total_paragraphs int, job_type string",
}
_KEYS = {"books": ("book_id",), "pages": ("book_id", "page_number"), "assets": ("book_id", "name"), "chapters": ("chapter_id",), "paragraphs": ("paragraph_id",), "fragments": ("paragraph_id", "fragment_order"), "translations": ("paragraph_id",), "jobs": ("job_id",)}
_PARENTS = {"pages": ("books", "book_id"), "assets": ("books", "book_id"), "chapters": ("books", "book_id"), "paragraphs": ("chapters", "chapter_id"), "jobs": ("chapters", "chapter_id"), "fragments": ("paragraphs", "paragraph_id"), "translations": ("paragraphs", "paragraph_id")}


def library(spark: SparkSession, path: str, buckets: int = 16) -> TableSet:
    """The tables of a library below path. Chapters, pages and assets hang on books, paragraphs and jobs on chapters, fragments and translations on paragraphs."""
    return TableSet(spark, path, [Table(n, StructType.fromDDL(c), _KEYS[n], buckets, {_PARENTS[n][1]: _PARENTS[n]} if n in _PARENTS else {}) for n, c in _COLUMNS.items()])


def chapter_id(book_id: Column, order: Column) -> Column:
    """The same for the same place in the same book, so that an insert that is run again inserts nothing new."""
    return F.md5(F.concat_ws("|", F.lit("chapter"), book_id.cast("string"), order.cast("string")))


def paragraph_id(chapter: Column, order: Column) -> Column:
    return F.md5(F.concat_ws("|", chapter, order.cast("string")))


def insert_structure(tx: Transaction, chapters: DataFrame, paragraphs: DataFrame, fragments: DataFrame) -> None:
    """Chapters, paragraphs, fragments and translation jobs of parsed books, in place of those the books had.

    chapters and paragraphs as `paragraphs.assemble` gives them, with para_idx; fragments with book_id, para_idx, fragment_order and box. A chapter without paragraphs
    gets no job. Pages and assets stay.
    """
    tx.delete("chapters", chapters.select("book_id").distinct(), ["book_id"])
    numbered = chapters.withColumn("chapter_id", chapter_id(F.col("book_id"), F.col("chapter_order")))
    tx.upsert("chapters", numbered.withColumn("translate_status", F.lit("pending")))
    parent = chapter_id(F.col("book_id"), F.col("chapter_order"))
    paras = paragraphs.withColumn("chapter_id", parent).withColumn("paragraph_id", paragraph_id(F.col("chapter_id"), F.col("paragraph_order")))
    tx.upsert("paragraphs", paras.withColumn("source_text", F.col("text")).withColumn("status", F.lit("pending")))
    owned = fragments.join(paras.select("book_id", "para_idx", "paragraph_id"), ["book_id", "para_idx"])
    tx.upsert("fragments", owned.withColumn("page_number", F.col("pdf_page_number")))
    job = F.md5(F.concat_ws("|", F.lit("translate"), F.col("chapter_id")))
    jobs = numbered.where("paragraph_count > 0").select(job.alias("job_id"), "chapter_id", F.lit("pending").alias("status"), F.col("paragraph_count").alias("total_paragraphs"), F.lit("translate").alias("job_type"))
    tx.upsert("jobs", jobs)
    tx.upsert("books", tx.read("books").join(chapters.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("__n")), "book_id").withColumns({"total_chapters": F.col("__n"), "parse_status": F.lit("completed")}).drop("__n"))


def delete_books(store: TableSet, book_ids: DataFrame) -> DataFrame:
    """Delete books with their pages, structure, jobs, translations and assets in one commit; the assets (book_id, name) whose files may now go.

    Ids without a book are no error and change nothing.
    """
    files = store.read("assets", version=store.versions()[-1]).join(book_ids.select("book_id").distinct(), "book_id", "left_semi")
    with store.transaction() as tx:
        tx.delete("books", book_ids.select("book_id"))
    return files
