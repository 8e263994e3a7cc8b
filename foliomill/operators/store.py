"""Keyed upserts, cascading deletes and state changes on tables without MERGE, UPDATE or DELETE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.functions.text import file_extension

FORMATS = (".pdf", ".epub")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, one for each key: the new one wins; among new ones the highest version, then the one whose columns sort last."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("__new"), *([F.desc(version)] if version else []), F.desc(F.struct(*rows.columns))]
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__new", "__r")


def delete_books(tables: dict[str, DataFrame], book_ids: DataFrame, keep_pages: bool = False, keep_cache: bool = False) -> dict[str, DataFrame]:
    """What is left of parse data after the books' chapters, paragraphs and all that hangs on them are deleted.

    tables: chapters, paragraphs, fragments, translations, jobs, pages. Chapters hang on books, paragraphs and jobs on
    chapters, fragments and translations on paragraphs. `keep_pages` spares pages, as a migration needs.
    """
    gone_chapters = tables["chapters"].join(book_ids, "book_id", "left_semi").select("chapter_id")
    gone_paras = tables["paragraphs"].join(gone_chapters, "chapter_id", "left_semi").select("paragraph_id")
    left = dict(tables)
    left["fragments"] = tables["fragments"].join(gone_paras, "paragraph_id", "left_anti")
    if not keep_cache:
        left["translations"] = tables["translations"].join(gone_paras, "paragraph_id", "left_anti")
    left["paragraphs"] = tables["paragraphs"].join(gone_chapters, "chapter_id", "left_anti")
    left["jobs"] = tables["jobs"].join(gone_chapters, "chapter_id", "left_anti")
    left["chapters"] = tables["chapters"].join(book_ids, "book_id", "left_anti")
    if not keep_pages:
        left["pages"] = tables["pages"].join(book_ids, "book_id", "left_anti")
    return left


def retry_failed(paragraphs: DataFrame) -> DataFrame:
    """Failed paragraphs wait again, without their error."""
    failed = F.col("status") == "failed"
    return paragraphs.withColumns({"error_message": F.when(failed, "").otherwise(F.col("error_message")), "status": F.when(failed, "pending").otherwise(F.col("status"))})


def recover_crashed(books: DataFrame) -> DataFrame:
    """Books left in the middle of parsing have failed."""
    stale = F.col("parse_status").isin("parsing", "assembling")
    return books.withColumn("parse_status", F.when(stale, "failed").otherwise(F.col("parse_status")))


def evolve(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns, in its order and types; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def ingest(files: DataFrame) -> DataFrame:
    """Book rows of uploaded files (path, modificationTime): supported formats only, ids from the path."""
    ext = file_extension(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(ext.isin(*FORMATS)).select(
        F.md5("path").alias("book_id"), name.alias("title"), F.substring(ext, 2, 10).alias("format"), F.col("path").alias("file_path"), F.lit("pending").alias("parse_status"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at")
    )


def write_books(df: DataFrame, path: str) -> None:
    """Write rows partitioned by book; only the books in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)
