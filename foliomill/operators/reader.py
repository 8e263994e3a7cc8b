"""Reading queries: book lists, section summaries, pages of paragraphs with their fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.rounding import py_round

FULL_SECTION = "__full__"
MOST_ROWS, DEFAULT_ROWS = 200, 50


def positive(x: Column, *fallbacks: Column | int) -> Column:
    """x unless it is null or 0, else the first fallback of which that holds; the last one as it is."""
    *some, last = [f if isinstance(f, Column) else F.lit(f) for f in fallbacks]
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in (x, *some)], last)


def check_page(offset: int, limit: int) -> None:
    if offset < 0 or not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"offset must be at least 0 and limit 1 to {MOST_ROWS}")


def progress_percent(parsed: Column, total: Column) -> Column:
    return F.when(total > 0, py_round(parsed / F.when(total > 0, total) * 100, 1)).otherwise(0.0)


def sections(chapters: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """Sections of every book: the virtual full section (sort_order -1), then its chapters.

    chapters: book_id, chapter_order, title, paragraph_count; paragraphs: book_id, chapter_order, page_number, page_end;
    books: book_id, total_pages. A chapter's start is the number of paragraphs before it.
    """
    of_chapter = paragraphs.groupBy("book_id", "chapter_order").agg(F.min("page_number").alias("p0"), F.max("page_end").alias("p1"), F.count(F.lit(1)).alias("n"))
    return sections_of_spans(chapters.join(of_chapter, ["book_id", "chapter_order"], "left"), books)


def sections_of_spans(spans: DataFrame, books: DataFrame) -> DataFrame:
    """As `sections`, from one row a chapter: book_id, chapter_order, title, paragraph_count, p0 and p1 (pages of its paragraphs), n (how many there are)."""
    order = W.partitionBy("book_id").orderBy("chapter_order")
    rows = spans.select(
        "book_id",
        F.col("chapter_order").cast("string").alias("section_id"),
        "title",
        F.col("chapter_order").alias("sort_order"),
        F.col("paragraph_count").cast("long").alias("paragraph_count"),
        positive(F.col("p0"), 0).cast("int").alias("page_start"),
        positive(F.col("p1"), 0).cast("int").alias("page_end"),
        F.coalesce(F.sum("paragraph_count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start_paragraph_order"),
    )
    whole = spans.groupBy("book_id").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.sum("n").alias("n"))
    full = books.join(whole, "book_id", "left").select(
        "book_id",
        F.lit(FULL_SECTION).alias("section_id"),
        F.lit("Full Text").alias("title"),
        F.lit(-1).alias("sort_order"),
        F.coalesce("n", F.lit(0)).cast("long").alias("paragraph_count"),
        positive(F.col("p0"), 1).cast("int").alias("page_start"),
        positive(F.col("p1"), F.col("total_pages")).cast("int").alias("page_end"),
        F.lit(None).cast("long").alias("start_paragraph_order"),
    )
    return full.unionByName(rows)


def nest_fragments(fragments: DataFrame, key: list[str]) -> DataFrame:
    """Fragments of each paragraph as one array in their order."""
    own = [c for c in fragments.columns if c not in key]
    first = ["fragment_order", *[c for c in own if c != "fragment_order"]]
    return fragments.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*first))).alias("source_fragments"))


def page_of_paragraphs(paragraphs: DataFrame, fragments: DataFrame, offset: int = 0, limit: int = DEFAULT_ROWS, by_chapter: bool = False) -> DataFrame:
    """One page of every book (or chapter), in reading order, each paragraph with its fragments.

    Give the fragment columns that are shown only: all fragments are nested by one grouping, without a first look at which are visible.
    """
    check_page(offset, limit)
    section = ["book_id", "chapter_order"] if by_chapter else ["book_id"]
    order = W.partitionBy(*section).orderBy("chapter_order", "paragraph_order")
    rows = paragraphs.withColumn("row_idx", (F.row_number().over(order) - 1).cast("int")).where((F.col("row_idx") >= offset) & (F.col("row_idx") < offset + limit))
    key = ["book_id", "para_idx"]
    joined = rows.join(nest_fragments(fragments, key), key, "left")
    page = positive(F.col("page_number"), 0).cast("int")
    return joined.withColumns({"page_start": page, "page_last": positive(F.col("page_end"), F.col("page_number"), 0).cast("int"), "n_fragments": F.coalesce(F.size("source_fragments"), F.lit(0))})


def page_label(start: Column, end: Column) -> Column:
    """P3, or P3–P4 if the range has more than one page."""
    return F.when(end > start, F.concat(F.lit("P"), start, F.lit("–P"), end)).otherwise(F.concat(F.lit("P"), start))


def target_page(fragments: Column) -> Column:
    """Page of a paragraph's first fragment, 1-based; 1 without any."""
    return F.coalesce(F.try_element_at(fragments, F.lit(1))["pdf_page_index"] + 1, F.lit(1))


def highlight(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A normalised box as percentages of the page: left, top, width, height."""
    return F.struct((x1 * 100).alias("left_pct"), (y1 * 100).alias("top_pct"), ((x2 - x1) * 100).alias("width_pct"), ((y2 - y1) * 100).alias("height_pct"))


def translation_label(status: Column, translation: Column) -> Column:
    return F.when(status == "completed", translation).when(status == "failed", "translation failed").when(status == "pending", "waiting for translation").otherwise("")


def book_card(books: DataFrame) -> DataFrame:
    """Display columns of the book list, newest first."""
    labels = F.create_map(*[F.lit(x) for pair in (("pending", "waiting"), ("parsing", "parsing"), ("completed", "ready"), ("failed", "failed")) for x in pair])
    return books.withColumns(
        {
            "status_label": F.coalesce(F.try_element_at(labels, F.col("parse_status")), F.lit("waiting")),
            "shown_at": F.coalesce(F.nullif(F.col("uploaded_at"), F.lit("")), F.col("created_at")),
            "chapter_label": F.when(F.col("total_chapters") > 0, F.concat(F.col("total_chapters"), F.lit(" chapters"))),
        }
    ).orderBy(F.desc("shown_at"), "book_id")


def chapter_display(chapters: DataFrame, active: str = "translating") -> DataFrame:
    """Add the 1-based `number` and `label` of chapters with a translate_status."""
    label = F.when(F.col("translate_status") == "completed", "translated").when(F.col("translate_status") == "partial", "partly translated").when(F.col("translate_status") == active, "in progress").otherwise("waiting")
    return chapters.withColumns({"number": F.col("chapter_order") + 1, "label": label})


def merge_poll(loaded: DataFrame, updates: DataFrame, key: str = "paragraph_id") -> DataFrame:
    """Loaded paragraphs with the status and translation of a newer snapshot, where that has them."""
    newer = updates.select(key, F.col("status").alias("__s"), F.col("translation").alias("__t"))
    return loaded.join(newer, key, "left").withColumns({"status": F.coalesce("__s", "status"), "translation": F.coalesce("__t", "translation")}).drop("__s", "__t")


def api_fields(jobs: DataFrame) -> DataFrame:
    """Job rows with the field names of progress events."""
    return jobs.withColumnsRenamed({"total_paragraphs": "total", "completed_paragraphs": "completed", "failed_paragraphs": "failed"})
