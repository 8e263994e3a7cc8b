"""Whole jobs: parse books, translate chapters, migrate translations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.operators import enrich, migrate, paragraphs, reader, store
from foliomill.sources.pages import from_page_rows
from foliomill.sources.scratch import saved, shared_folder


def parse_books(pages: DataFrame) -> dict[str, DataFrame]:
    """Stored page results to chapters, paragraphs, fragments and the state of each book.

    A book without any completed page with lines has failed.
    """
    chapters, paras, fragments = paragraphs.assemble(from_page_rows(pages))
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if(F.col("status") == "failed").alias("failed_pages"))
    made = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_chapters"))
    books = counts.join(made, "book_id", "left").withColumns({"parse_status": F.when(F.col("total_chapters") > 0, "completed").otherwise("failed"), "total_chapters": F.coalesce("total_chapters", F.lit(0))})
    return {"books": books, "chapters": chapters, "paragraphs": paras, "fragments": fragments}


def pending_items(paras: DataFrame, statuses: tuple[str, ...] = ("pending",)) -> DataFrame:
    """Paragraphs that wait for translation, a job for each chapter: paragraphs need paragraph_id, chapter_id, status, text.

    A reader that opens a chapter takes failed ones too: statuses ("pending", "failed").
    """
    return paras.where(F.col("status").isin(*statuses)).select(F.col("chapter_id").alias("job_id"), F.col("paragraph_id").alias("id"), "paragraph_order", "text")


def translate_chapters(paras: DataFrame, cache: DataFrame, provider: Callable[[], enrich.Provider], prompt: str = "", statuses: tuple[str, ...] = ("pending",)) -> dict[str, DataFrame]:
    """Translate what is pending; results, paragraphs, cache, jobs and chapters as they are afterwards.

    Results are written to the shared folder first: all five read the same ones.
    """
    asked = enrich.translate(pending_items(paras, statuses), cache, provider, ["paragraph_order"], prompt)
    results = saved(asked, shared_folder(paras.sparkSession), "results")
    done = results.select(F.col("id").alias("paragraph_id"), F.col("translation").alias("__t"), F.col("status").alias("__s"), F.col("message").alias("__m"))
    joined = paras.join(done, "paragraph_id", "left")
    after = joined.withColumns({"translation": F.coalesce("__t", "translation"), "error_message": F.coalesce("__m", "error_message"), "status": F.coalesce("__s", "status")}).drop("__t", "__s", "__m")
    jobs = enrich.status_counts(results, ["job_id"]).withColumn("status", enrich.job_status())
    chapters = enrich.status_counts(after, ["chapter_id"]).withColumn("translate_status", enrich.chapter_status())
    fresh = enrich.cache_rows(results)
    return {"results": results, "paragraphs": after, "cache": store.upsert(cache.select("source_hash", "translated_text", "status"), fresh.select("source_hash", "translated_text", "status"), ["source_hash"]), "jobs": jobs, "chapters": chapters}


def migrate_books(pages: DataFrame, old: DataFrame) -> DataFrame:
    """Paragraphs of re-assembled books with the translations of their most similar old ones.

    old: book_id, old_id, old_order, page_number, old_text, translation.
    """
    _, paras, _ = paragraphs.assemble(from_page_rows(pages))
    order = W.partitionBy("book_id").orderBy("chapter_order", "paragraph_order")
    new = paras.withColumn("new_id", F.row_number().over(order))
    matched = migrate.best_matches(new.select("book_id", "new_id", "page_number", "text"), old)
    return new.join(matched, ["book_id", "new_id"])


def chapter_translations(paras: DataFrame) -> DataFrame:
    """Translated paragraphs of each chapter beside its totals, for polling readers."""
    chapter = W.partitionBy("chapter_id")
    done = F.count_if(F.col("status") == "completed").over(chapter)
    return paras.withColumns({"total": F.count(F.lit(1)).over(chapter), "completed": done, "shown": reader.translation_label(F.col("status"), F.col("translation"))})
