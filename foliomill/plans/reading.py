"""Reading queries over the books derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import paragraphs as P
from foliomill.operators import reader as R
from foliomill.plans import fixtures as X
from foliomill.plans.structure import FRAGMENTS_SQL, assigned
from foliomill.sources.scratch import saved, saved_by, shared_folder

OFFSET, LIMIT = 0, 50


def structure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and fragments of all books; marked lines and paragraphs are written once, by book, and read by both."""
    folder = shared_folder(spark)
    marked = saved_by(P.mark_breaks(X.body_lines(spark, d)), folder, "lines", "book_id")
    paras = saved_by(P.merge_paragraphs(marked), folder, "paragraphs", "book_id")
    return P.chapter_paragraphs(P.assign_chapters(P.merge_across_pages(paras))), P.merged_fragments(P.source_fragments(marked), paras)


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return P.chapters(assigned(spark, d))


def books(spark: SparkSession, d: str) -> DataFrame:
    """Book rows: states and counters are derived from ids and lengths."""
    docs = X.table(spark, d, "documents")
    state = F.element_at(F.array(*[F.lit(x) for x in ("pending", "parsing", "completed", "failed", "archived")]), (F.col("doc_id") % 5 + 1).cast("int"))
    total = (F.floor(F.col("n_chars") / 400) + F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1)).cast("int")
    total = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(total)
    when = lambda n: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + n), "yyyy-MM-dd HH:mm:ss")
    return docs.select(
        F.col("doc_id").alias("book_id"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"),
        state.alias("parse_status"),
        total.alias("total_pages"),
        F.floor(total * (F.col("doc_id") % 4) / 3).cast("int").alias("parsed_pages"),
        (F.col("doc_id") % 3).cast("int").alias("total_chapters"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(when(F.col("doc_id") * 3600)).alias("uploaded_at"),
        when(F.col("doc_id") * 60).alias("created_at"),
    )


BOOKS_SQL = """books AS (SELECT doc_id AS book_id, concat_ws('-', source, CAST(doc_id AS VARCHAR)) AS title, ['pending', 'parsing', 'completed', 'failed', 'archived'][doc_id % 5 + 1] AS parse_status,
  total AS total_pages, CAST(floor(total * (doc_id % 4) / 3) AS INT) AS parsed_pages, CAST(doc_id % 3 AS INT) AS total_chapters,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE strftime(make_timestamp((1700000000 + doc_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') END AS uploaded_at,
  strftime(make_timestamp((1700000000 + doc_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(floor(n_chars / 400.0) + 1 AS INT) END AS total FROM documents))"""


def reader_page_full(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every book's full text: 50 paragraphs with their source fragments."""
    paras, frags = structure(spark, d)
    page = R.page_of_paragraphs(paras, frags.select("book_id", "para_idx", "fragment_order", "pdf_page_index"), OFFSET, LIMIT)
    return page.select("book_id", "row_idx", "chapter_order", "paragraph_order", "text", "page_start", "page_last", "n_fragments", R.target_page(F.col("source_fragments")).cast("int").alias("target_page"), R.page_label(F.col("page_start"), F.col("page_last")).alias("label"))


def section_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Rows 2 to 4 of every chapter."""
    paras, frags = structure(spark, d)
    return R.page_of_paragraphs(paras, frags.select("book_id", "para_idx", "fragment_order"), 1, 3, by_chapter=True).select("book_id", "chapter_order", "row_idx", "text", "page_start", "page_last", "n_fragments")


def fragments_nested_counts(spark: SparkSession, d: str) -> DataFrame:
    paras, frags = structure(spark, d)
    nested = R.nest_fragments(frags.select("book_id", "para_idx", "fragment_order"), ["book_id", "para_idx"])
    joined = paras.join(nested, ["book_id", "para_idx"], "left")
    return joined.groupBy("book_id").agg(F.sum(F.coalesce(F.size("source_fragments"), F.lit(0))).cast("long").alias("n_fragments"), F.count(F.lit(1)).alias("n_paragraphs"))


def fragment_orders(spark: SparkSession, d: str) -> DataFrame:
    """Fragment orders after paragraphs were merged across pages."""
    _, frags = structure(spark, d)
    return frags.select("book_id", "para_idx", "fragment_order", "pdf_page_number", "source_text")


def reader_sections(spark: SparkSession, d: str) -> DataFrame:
    spans = P.chapter_spans(assigned(spark, d)).withColumn("n", F.col("paragraph_count"))
    found = R.sections_of_spans(saved(spans, shared_folder(spark), "spans"), books(spark, d).select("book_id", "total_pages"))
    return found.withColumn("start_paragraph_order", F.coalesce("start_paragraph_order", F.lit(-1)))


def book_list(spark: SparkSession, d: str) -> DataFrame:
    return R.book_card(books(spark, d)).select("book_id", "title", "status_label", "shown_at", "chapter_label")


def book_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every completed book with its chapters in order."""
    own = books(spark, d).where("parse_status = 'completed'")
    return own.join(chapters(spark, d).withColumnRenamed("title", "chapter_title"), "book_id").select("book_id", "title", (F.col("chapter_order") + 1).alias("chapter_number"), "chapter_title", "paragraph_count").orderBy("book_id", "chapter_number")


def book_progress(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("book_id", "parse_status", "parsed_pages", "total_pages", R.progress_percent(F.col("parsed_pages"), F.col("total_pages")).alias("percent"))


def highlight_boxes(spark: SparkSession, d: str) -> DataFrame:
    frags = P.source_fragments(P.mark_breaks(X.body_lines(spark, d)))
    box = R.highlight(*[F.col(f"norm_{c}") for c in ("x1", "y1", "x2", "y2")])
    return frags.withColumn("box", box).select("book_id", "para_idx", "fragment_order", *[F.round(f"box.{c}", 6).alias(c) for c in ("left_pct", "top_pct", "width_pct", "height_pct")])


def chapter_display(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("completed"), F.lit("partial"), F.lit("pending"), F.lit("translating")), ((F.col("book_id") + F.col("chapter_order")) % 4 + 1).cast("int"))
    return R.chapter_display(chapters(spark, d).withColumn("translate_status", state)).select("book_id", "number", "title", "label")


def polling_merge(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as loaded paragraphs; every third turn has a newer snapshot."""
    turns = X.table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("paragraph_id"), F.lit("pending").alias("status"), F.lit("").alias("translation"), "turn", "role")
    newer = turns.where("turn % 3 = 0").select("paragraph_id", F.lit("completed").alias("status"), F.col("role").alias("translation"))
    return R.merge_poll(turns.drop("turn", "role"), newer).select("paragraph_id", "status", "translation", R.translation_label(F.col("status"), F.col("translation")).alias("shown"))


QUERIES = {
    "chapter_display": chapter_display, "polling_merge": polling_merge, "reader_page_full": reader_page_full, "section_paragraphs": section_paragraphs, "fragments_nested_counts": fragments_nested_counts, "fragment_orders": fragment_orders, "reader_sections": reader_sections,
    "book_list": book_list, "book_detail": book_detail, "book_progress": book_progress, "highlight_boxes": highlight_boxes,
}

_MERGED_FRAGMENTS = FRAGMENTS_SQL + """,
with_merge AS (SELECT f.*, merge_idx, min(m.para_idx) OVER (PARTITION BY f.book_id, merge_idx) AS first_with FROM frags f JOIN merge_ids m ON f.book_id = m.book_id AND f.para_idx = m.para_idx),
firsts AS (SELECT book_id, merge_idx, min(para_idx) AS first_para FROM merge_ids GROUP BY ALL),
part_counts AS (SELECT book_id, merge_idx, para_idx, count(*) AS n FROM with_merge GROUP BY ALL),
offsets AS (SELECT p.book_id, p.merge_idx, p.para_idx, CASE WHEN p.para_idx = first_para THEN 0 ELSE greatest(coalesce(sum(n) OVER (PARTITION BY p.book_id, p.merge_idx ORDER BY p.para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1) END AS shift
  FROM part_counts p JOIN firsts f ON p.book_id = f.book_id AND p.merge_idx = f.merge_idx),
moved AS (SELECT w.book_id, w.merge_idx AS para_idx, CAST(fragment_order + shift AS INT) AS fragment_order, CAST(page_number AS INT) AS pdf_page_number, source_text FROM with_merge w JOIN offsets o ON w.book_id = o.book_id AND w.para_idx = o.para_idx)"""
_FULL = f"WITH {X.STRUCTURE_SQL}{_MERGED_FRAGMENTS}"
_PAGE = """, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY chapter_order, paragraph_order) - 1 AS INT) AS row_idx FROM content),
page AS (SELECT n.*, coalesce(k, 0) AS n_fragments, coalesce(first_page, 1) AS target_page FROM numbered n
  LEFT JOIN (SELECT book_id, para_idx, CAST(count(*) AS INT) AS k, arg_min(pdf_page_number, fragment_order) AS first_page FROM moved GROUP BY ALL) f ON n.book_id = f.book_id AND n.para_idx = f.para_idx WHERE row_idx >= {lo} AND row_idx < {hi})"""

ORACLES = {
    "chapter_display": f"""WITH {X.STRUCTURE_SQL} SELECT book_id, chapter_order + 1 AS number, title, CASE (book_id + chapter_order) % 4 WHEN 0 THEN 'translated' WHEN 1 THEN 'partly translated' WHEN 3 THEN 'in progress' ELSE 'waiting' END AS label FROM chapters""",
    "polling_merge": """SELECT conv_id || '/' || turn AS paragraph_id, CASE WHEN turn % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS translation,
  CASE WHEN turn % 3 = 0 THEN role ELSE 'waiting for translation' END AS shown FROM conversations""",
    "reader_page_full": _FULL + _PAGE.format(part="book_id", lo=0, hi=50) + """ SELECT book_id, row_idx, chapter_order, paragraph_order, text, page_number AS page_start, page_end AS page_last, n_fragments, CAST(target_page AS INT) AS target_page,
  CASE WHEN page_end > page_number THEN 'P' || page_number || '–P' || page_end ELSE 'P' || page_number END AS label FROM page""",
    "section_paragraphs": _FULL + _PAGE.format(part="book_id, chapter_order", lo=1, hi=4) + " SELECT book_id, chapter_order, row_idx, text, page_number AS page_start, page_end AS page_last, n_fragments FROM page",
    "fragments_nested_counts": _FULL + ", k AS (SELECT book_id, para_idx, count(*) AS k FROM moved GROUP BY ALL) SELECT c.book_id, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_fragments, count(*) AS n_paragraphs FROM content c LEFT JOIN k ON c.book_id = k.book_id AND c.para_idx = k.para_idx GROUP BY c.book_id",
    "fragment_orders": _FULL + " SELECT * FROM moved",
    "reader_sections": f"""WITH {BOOKS_SQL}, {X.STRUCTURE_SQL},
spans AS (SELECT book_id, chapter_order, min(page_number) AS p0, max(page_end) AS p1, count(*) AS n FROM content GROUP BY ALL)
SELECT book_id, CAST(chapter_order AS VARCHAR) AS section_id, title, chapter_order AS sort_order, CAST(paragraph_count AS BIGINT) AS paragraph_count, CAST(coalesce(nullif(p0, 0), 0) AS INT) AS page_start, CAST(coalesce(nullif(p1, 0), 0) AS INT) AS page_end,
  CAST(coalesce(sum(paragraph_count) OVER (PARTITION BY book_id ORDER BY chapter_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_paragraph_order FROM chapters LEFT JOIN spans USING (book_id, chapter_order)
UNION ALL
SELECT b.book_id, '__full__', 'Full Text', -1, CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(nullif(min(p0), 0), 1) AS INT), CAST(coalesce(nullif(max(p1), 0), any_value(total_pages)) AS INT), -1 FROM books b LEFT JOIN spans s ON b.book_id = s.book_id GROUP BY b.book_id""",
    "book_list": f"""WITH {BOOKS_SQL} SELECT book_id, title, CASE parse_status WHEN 'parsing' THEN 'parsing' WHEN 'completed' THEN 'ready' WHEN 'failed' THEN 'failed' ELSE 'waiting' END AS status_label, coalesce(nullif(uploaded_at, ''), created_at) AS shown_at,
  CASE WHEN total_chapters > 0 THEN total_chapters || ' chapters' END AS chapter_label FROM books""",
    "book_detail": f"WITH {BOOKS_SQL}, {X.STRUCTURE_SQL} SELECT b.book_id, b.title, chapter_order + 1 AS chapter_number, c.title AS chapter_title, paragraph_count FROM books b JOIN chapters c ON b.book_id = c.book_id WHERE parse_status = 'completed'",
    "book_progress": f"WITH {BOOKS_SQL} SELECT book_id, parse_status, parsed_pages, total_pages, CASE WHEN total_pages > 0 THEN CAST(format('{{:.1f}}', parsed_pages / total_pages * 100) AS DOUBLE) ELSE 0.0 END AS percent FROM books",
    "highlight_boxes": "WITH " + X.BODY_SQL + X.BREAKS_SQL.replace("{source}", "body") + FRAGMENTS_SQL + """ SELECT book_id, para_idx, fragment_order, round(round(x1 / 1700, 6) * 100, 6) AS left_pct, round(round(y1 / 2200, 6) * 100, 6) AS top_pct,
  round((round(x2 / 1700, 6) - round(x1 / 1700, 6)) * 100, 6) AS width_pct, round((round(y2 / 2200, 6) - round(y1 / 2200, 6)) * 100, 6) AS height_pct FROM frags""",
}
