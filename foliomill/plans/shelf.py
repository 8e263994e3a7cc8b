"""Queries over a library: tables that change by one commit at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import library as Y
from foliomill.operators import paragraphs as P
from foliomill.plans import fixtures as X
from foliomill.plans.live import page_results, stream_of
from foliomill.sources.scratch import saved_by, shared_folder
from foliomill.sources.tables import TableSet
from foliomill.streaming import progress as G


def _filled(spark: SparkSession, d: str) -> TableSet:
    """Every document as a book with its pages, an asset on every third page, and its structure."""
    folder = shared_folder(spark)
    store = Y.library(spark, f"{folder}/library")
    docs = X.table(spark, d, "documents")
    pages = page_results(docs).select("book_id", "page_number", "status", F.lit(1).alias("version"))
    with store.transaction() as tx:
        tx.upsert("books", docs.select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"), F.lit("assembling").alias("parse_status")))
        tx.upsert("pages", pages, "version")
        tx.upsert("assets", pages.where("page_number % 3 = 0").select("book_id", F.concat(F.lit("page-"), F.col("page_number").cast("string"), F.lit(".png")).alias("name")))
    marked = saved_by(P.mark_breaks(X.body_lines(spark, d)), folder, "lines", "book_id")
    paras = saved_by(P.merge_paragraphs(marked), folder, "paragraphs", "book_id")
    assigned = saved_by(P.assign_chapters(P.merge_across_pages(paras)), folder, "assigned", "book_id")
    with store.transaction() as tx:
        Y.insert_structure(tx, P.chapters(assigned), P.chapter_paragraphs(assigned), P.merged_fragments(P.source_fragments(marked), paras))
    return store


def structure_insert(spark: SparkSession, d: str) -> DataFrame:
    """What one commit put into the tables of chapters, paragraphs, fragments, jobs and books: ids and what they hang on."""
    store = _filled(spark, d)
    rows = {
        "books": ("CAST(book_id AS STRING)", "parse_status", "total_chapters"),
        "chapters": ("chapter_id", "CAST(book_id AS STRING)", "paragraph_count"),
        "paragraphs": ("paragraph_id", "chapter_id", "length(source_text)"),
        "fragments": ("concat(paragraph_id, '/', fragment_order)", "paragraph_id", "page_number"),
        "jobs": ("job_id", "chapter_id", "total_paragraphs"),
    }
    parts = [store.read(n).selectExpr(f"'{n}' AS table_name", f"{a} AS id", f"{b} AS parent", f"CAST({c} AS BIGINT) AS n") for n, (a, b, c) in rows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete_book(spark: SparkSession, d: str) -> DataFrame:
    """What is left, by table and book, after the books of one source are deleted whole."""
    store = _filled(spark, d)
    gone = X.table(spark, d, "documents").where("source = 'src0' OR doc_id % 4 = 1").select(F.col("doc_id").alias("book_id"))
    files = Y.delete_books(store, gone)
    chapters = store.read("chapters").select("chapter_id", "book_id")
    paras = store.read("paragraphs").select("paragraph_id", "chapter_id").join(chapters, "chapter_id", "left")
    of_book = {n: store.read(n).select("book_id") for n in ("books", "pages", "assets")} | {"chapters": chapters.select("book_id"), "paragraphs": paras.select("book_id")}
    of_book["jobs"] = store.read("jobs").join(chapters, "chapter_id", "left").select("book_id")
    of_book["fragments"] = store.read("fragments").join(paras, "paragraph_id", "left").select("book_id")
    of_book["removed_files"] = files.select("book_id")
    out = None
    for name, df in of_book.items():
        part = df.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "book_id", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def stream_page_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a stream of documents, kept by bucket; then the even pages of every third book once more, as version 2."""
    folder = shared_folder(spark)
    store = Y.library(spark, f"{folder}/library")
    results = page_results(stream_of(spark, d, "documents")).withColumn("version", F.lit(1))
    G.upsert_pages(results, store, "pages", f"{folder}/checkpoint", "version").awaitTermination()
    again = store.read("pages").where("book_id % 3 = 0 AND page_number % 2 = 0").withColumns({"status": F.lit("completed"), "version": F.lit(2), "raw_text": F.lit("again")})
    with store.transaction() as tx:
        tx.upsert("pages", again, "version")
    return store.read("pages").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


QUERIES = {"structure_insert": structure_insert, "delete_book": delete_book, "stream_page_upserts": stream_page_upserts}

_PAGES = "pages_ AS (SELECT DISTINCT book_id, page_number FROM body)"
_IDS = f"""WITH {X.STRUCTURE_SQL}{{fragments}}, {_PAGES},
ch AS (SELECT *, md5('chapter|' || book_id || '|' || chapter_order) AS chapter_id FROM chapters),
pa AS (SELECT *, md5('chapter|' || book_id || '|' || chapter_order) AS chapter_id, md5(md5('chapter|' || book_id || '|' || chapter_order) || '|' || paragraph_order) AS paragraph_id FROM content),
fr AS (SELECT p.book_id, p.paragraph_id, f.page_number, row_number() OVER (PARTITION BY f.book_id, m.merge_idx ORDER BY f.para_idx, f.fragment_order) - 1 AS fragment_order
  FROM frags f JOIN merge_ids m USING (book_id, para_idx) JOIN pa p ON p.book_id = f.book_id AND p.para_idx = m.merge_idx)"""


def _oracles() -> dict[str, str]:
    from foliomill.plans.structure import FRAGMENTS_SQL

    ids = _IDS.replace("{fragments}", FRAGMENTS_SQL)
    kept = "(SELECT doc_id FROM documents WHERE NOT (source = 'src0' OR doc_id % 4 = 1))"
    tables = {"pages": "pages_", "chapters": "ch", "paragraphs": "pa", "fragments": "fr"}
    left = " UNION ALL ".join(f"SELECT '{n}' AS table_name, book_id, count(*) AS n_rows FROM {t} WHERE book_id IN {kept} GROUP BY book_id" for n, t in tables.items())
    return {
        "structure_insert": ids
        + """ SELECT 'chapters' AS table_name, chapter_id AS id, CAST(book_id AS VARCHAR) AS parent, CAST(paragraph_count AS BIGINT) AS n FROM ch
UNION ALL SELECT 'books', CAST(book_id AS VARCHAR), 'completed', count(*) FROM ch GROUP BY book_id
UNION ALL SELECT 'books', CAST(doc_id AS VARCHAR), 'assembling', NULL FROM documents WHERE doc_id NOT IN (SELECT book_id FROM ch)
UNION ALL SELECT 'paragraphs', paragraph_id, chapter_id, length(text) FROM pa
UNION ALL SELECT 'fragments', paragraph_id || '/' || fragment_order, paragraph_id, page_number FROM fr
UNION ALL SELECT 'jobs', md5('translate|' || chapter_id), chapter_id, paragraph_count FROM ch WHERE paragraph_count > 0""",
        "delete_book": f"""{ids} {left} UNION ALL SELECT 'books', doc_id, 1 FROM documents WHERE doc_id IN {kept}
UNION ALL SELECT 'jobs', book_id, count(*) FROM ch WHERE paragraph_count > 0 AND book_id IN {kept} GROUP BY book_id
UNION ALL SELECT CASE WHEN book_id IN {kept} THEN 'assets' ELSE 'removed_files' END, book_id, count(*) FROM pages_ WHERE page_number % 3 = 0 GROUP BY book_id""",
        "stream_page_upserts": f"""WITH {X.BODY_SQL}, {_PAGES}, v AS (SELECT *, book_id % 3 = 0 AND page_number % 2 = 0 AS again FROM pages_)
SELECT book_id, page_number, CASE WHEN again OR page_number % 5 > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN again THEN 2 ELSE 1 END AS version, CASE WHEN again THEN 'again' ELSE '' END AS raw_text FROM v""",
    }


ORACLES = _oracles()
