"""Paragraphs, source fragments and chapters, as gaps and islands over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.rounding import py_round, py_round_once
from foliomill.functions.text import FRONT_MATTER, FULL_TEXT, clean_pdf_text, ends_sentence, html_escape, is_heading, starts_lower, strip
from foliomill.sources.scratch import saved_by, shared_folder

def _book():
    return W.partitionBy("book_id")


def is_centred(x1: Column, x2: Column, page_w: Column) -> Column:
    middle = F.abs((x1 + x2) / 2 - page_w / 2) < page_w * 0.08
    return F.coalesce((page_w > 0) & middle & (x1 > page_w * 0.15) & ((x2 - x1) < page_w * 0.55), F.lit(False))


def mark_breaks(lines: DataFrame) -> DataFrame:
    """Add `is_break`, `para_idx` (0-based in the book) and `centred` to lines."""
    order = _book().orderBy("line_idx")
    before = lambda c: F.lag(c).over(order)
    height = F.col("y2") - F.col("y1")
    ph, ch, gap = F.col("__ph"), F.col("__ch"), F.col("__gap")
    got = lines.withColumns(
        {
            "__left": F.median("x1").over(W.partitionBy("book_id", "page_number")),
            "__ph": before("y2") - before("y1"),
            "__ch": height,
            "__gap": F.col("y1") - before("y2"),
            "__dx": F.abs(F.col("x1") - before("x1")),
            "__pw": before("x2") - before("x1"),
            "__ended": F.lag(ends_sentence(strip(F.col("text")))).over(order),
            "centred": is_centred(F.col("x1"), F.col("x2"), F.col("page_w")),
        }
    )
    tall = (ph > 0) & (ch > 0)
    rules = [
        strip(F.col("text")) == "",
        (ph > 0) & (gap > ph * 1.5),
        F.col("x1") - F.col("__left") > 15,
        tall & (F.col("__dx") > F.greatest(ph, ch) * 2),
        (F.col("page_w") > 0) & (F.col("__pw") < F.col("page_w") * 0.55) & F.col("__ended"),
        tall & (F.greatest(ph, ch) / F.when(F.least(ph, ch) > 0, F.least(ph, ch)) > 1.30),
        F.col("centred"),
    ]
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.coalesce(rule, F.lit(False))
    marked = got.withColumn("is_break", F.coalesce(F.lag(F.lit(True)).over(order), F.lit(False)) & hit)
    return marked.withColumn("para_idx", F.sum(F.col("is_break").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).select(*lines.columns, "is_break", "para_idx", "centred")


def _weighted(parts: Column) -> Column:
    """Confidence by text length over an ordered array of lines, rounded to four places."""
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    weight = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["confidence"] * p["n"])
    return F.coalesce(py_round_once(weight / F.when(total > 0, total), 4), F.when(total > 0, None).otherwise(0.0))


def _joined_text(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), " ")


def _measured(lines: DataFrame) -> DataFrame:
    """Lines with their text stripped, and its length before that as `n`: once a line, not at each place that a fold names them."""
    return lines.withColumns({"n": F.length("text"), "text": strip(F.col("text"))})


def merge_paragraphs(marked: DataFrame) -> DataFrame:
    """One row for each paragraph: book_id, para_idx, text, page_number, page_end, confidence, is_centred, n_lines."""
    parts = F.sort_array(F.collect_list(F.struct("line_idx", "text", "confidence", "centred", "n")))
    page = F.col("page_number")
    grouped = _measured(marked).groupBy("book_id", "para_idx").agg(parts.alias("__parts"), F.min(F.when(page != 0, page)).alias("__p0"), F.max(F.when(page != 0, page)).alias("__p1"))
    return grouped.select(
        "book_id",
        "para_idx",
        clean_pdf_text(_joined_text(F.col("__parts"))).alias("text"),
        F.coalesce("__p0", F.lit(0)).cast("int").alias("page_number"),
        F.coalesce("__p1", F.lit(0)).cast("int").alias("page_end"),
        _weighted(F.col("__parts")).alias("confidence"),
        F.element_at("__parts", 1)["centred"].alias("is_centred"),
        F.size("__parts").alias("n_lines"),
    )


def source_fragments(marked: DataFrame) -> DataFrame:
    """One row for each region of a paragraph: lines of one page without a gap of over 1.5 line heights."""
    in_page = W.partitionBy("book_id", "para_idx", "page_number").orderBy("y1", "line_idx")
    prev_h = F.lag("y2").over(in_page) - F.lag("y1").over(in_page)
    apart = F.coalesce((prev_h > 0) & (F.col("y1") - F.lag("y2").over(in_page) > prev_h * 1.5), F.lit(False))
    cut = marked.withColumn("__apart", apart).withColumns({"__part": F.sum(F.col("__apart").cast("int")).over(in_page.rowsBetween(W.unboundedPreceding, 0)), "__at": F.row_number().over(in_page)})
    regions = _measured(cut).groupBy("book_id", "para_idx", "page_number", "__part").agg(
        F.sort_array(F.collect_list(F.struct("__at", "text", "confidence", "n"))).alias("__parts"), F.max(F.col("text") != "").alias("__any"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"),
    )
    regions = regions.withColumns({"source_text": _joined_text(F.col("__parts")), "confidence": _weighted(F.col("__parts"))}).where("__any")
    w, h = F.coalesce("page_w", F.lit(0.0)), F.coalesce("page_h", F.lit(0.0))
    share = lambda c, size, ok: F.when(ok, py_round(F.col(c) / F.when(size > 0, size), 6)).otherwise(0.0).alias(f"norm_{c}")
    order = W.partitionBy("book_id", "para_idx").orderBy("page_number", "__part")
    return regions.select(
        "book_id", "para_idx", (F.row_number().over(order) - 1).cast("int").alias("fragment_order"),
        (F.col("page_number") - 1).cast("int").alias("pdf_page_index"), F.col("page_number").cast("int").alias("pdf_page_number"),
        "x1", "y1", "x2", "y2", share("x1", w, w > 0), share("y1", h, (w > 0) & (h > 0)), share("x2", w, w > 0), share("y2", h, (w > 0) & (h > 0)),
        w.alias("original_page_width"), h.alias("original_page_height"), "source_text", "confidence", F.lit("").alias("parse_method"),
    )


def mark_merges(paragraphs: DataFrame) -> DataFrame:
    """Add `merge_idx`: paragraphs that continue the one before them, on its last page or the next, share it."""
    order = _book().orderBy("para_idx")
    before, end = F.lag("text").over(order), F.lag("page_end").over(order)
    continues = (
        F.col("page_number").isin(0) & F.lit(False)
        | ((F.col("page_number") == end) | (F.col("page_number") == end + 1)) & (before != "") & ~ends_sentence(before) & starts_lower(F.col("text")) & ~F.col("is_centred")
    )
    marked = paragraphs.withColumn("__new", ~F.coalesce(continues, F.lit(False)))
    return marked.withColumn("merge_idx", (F.sum(F.col("__new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("__new")


def merge_across_pages(paragraphs: DataFrame) -> DataFrame:
    """Join continued paragraphs. The confidence is averaged, and rounded, step by step."""
    parts = F.sort_array(F.collect_list(F.struct("para_idx", "text", "confidence", "page_number", "page_end", "is_centred", "n")))
    grouped = mark_merges(paragraphs).withColumn("n", F.length("text")).groupBy("book_id", "merge_idx").agg(parts.alias("__p"))
    first = F.element_at("__p", 1)
    start = F.struct(first["n"].alias("n"), first["confidence"].alias("c"))

    def step(acc: Column, p: Column) -> Column:
        n = p["n"]
        mean = py_round_once((acc["c"] * acc["n"] + p["confidence"] * n) / F.when(acc["n"] + n > 0, acc["n"] + n), 4)
        return F.struct((acc["n"] + 1 + n).alias("n"), F.coalesce(mean, acc["c"]).alias("c"))

    return grouped.select(
        "book_id",
        F.col("merge_idx").alias("para_idx"),
        F.array_join(F.transform("__p", lambda p: p["text"]), " ").alias("text"),
        first["page_number"].alias("page_number"),
        F.element_at("__p", -1)["page_end"].alias("page_end"),
        F.aggregate(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(1))), start, step, lambda acc: acc["c"]).alias("confidence"),
        first["is_centred"].alias("is_centred"),
        F.size("__p").alias("n_merged"),
    )


def merged_fragments(fragments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Fragments of merged paragraphs: orders go on after those of the parts before (at least from 1)."""
    parts = W.partitionBy("book_id", "merge_idx")
    to = mark_merges(paragraphs).select("book_id", "para_idx", "merge_idx").withColumn("__first", F.min("para_idx").over(parts))
    before = F.rank().over(parts.orderBy("para_idx")) - 1  # fragments of the parts before
    offset = F.when(F.col("para_idx") == F.col("__first"), 0).otherwise(F.greatest(before, F.lit(1)))
    moved = fragments.join(to, ["book_id", "para_idx"]).withColumn("__offset", offset.cast("int"))
    own = [c for c in fragments.columns if c not in ("book_id", "para_idx", "fragment_order")]
    return moved.select("book_id", F.col("merge_idx").alias("para_idx"), (F.col("fragment_order") + F.col("__offset")).alias("fragment_order"), *own)


def assign_chapters(paragraphs: DataFrame) -> DataFrame:
    """Add heading flags and the chapter of each paragraph: `is_head`, `chapter_order`, `title`.

    Without any heading a book is one chapter; non-blank text before the first one is the front matter. Blank text
    alone before it belongs to no chapter (-1).
    """
    order = _book().orderBy("para_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    marked = paragraphs.withColumn("is_head", is_heading(F.col("text")))
    marked = marked.withColumns(
        {
            "__nth": F.sum(F.col("is_head").cast("int")).over(so_far),
            "__heads": F.sum(F.col("is_head").cast("int")).over(_book()),
            "__title": F.last(F.when(F.col("is_head"), strip(F.col("text"))), ignorenulls=True).over(so_far),
        }
    )
    front = F.max(F.when((F.col("__nth") == 0) & (strip(F.col("text")) != ""), 1).otherwise(0)).over(_book())
    marked = marked.withColumn("__front", F.when(F.col("__heads") > 0, front).otherwise(0))
    return marked.withColumns(
        {
            "chapter_order": F.when(F.col("__heads") == 0, 0).when(F.col("__nth") == 0, F.col("__front") - 1).otherwise(F.col("__nth") - 1 + F.col("__front")).cast("int"),
            "title": F.when(F.col("__heads") == 0, FULL_TEXT).when(F.col("__nth") == 0, FRONT_MATTER).otherwise(F.col("__title")),
        }
    ).drop("__nth", "__heads", "__title", "__front")


def chapter_paragraphs(assigned: DataFrame) -> DataFrame:
    """Non-blank content paragraphs with their 0-based `paragraph_order` in the chapter and their HTML."""
    content = assigned.where(~F.col("is_head") & (strip(F.col("text")) != ""))
    order = W.partitionBy("book_id", "chapter_order").orderBy("para_idx")
    return content.withColumns({"paragraph_order": (F.row_number().over(order) - 1).cast("int"), "html": F.concat(F.lit("<p>"), html_escape(F.col("text")), F.lit("</p>"))}).drop("is_head")


def chapter_spans(assigned: DataFrame) -> DataFrame:
    """One row for each chapter, empty ones included, in one aggregate: book_id, chapter_order, title, paragraph_count, and of its content the first and last page (p0, p1)."""
    content = ~F.col("is_head") & (strip(F.col("text")) != "")
    marked = assigned.withColumn("__content", content)
    grouped = marked.groupBy("book_id", "chapter_order").agg(
        F.first("title").alias("title"), F.sum(F.col("__content").cast("int")).cast("int").alias("paragraph_count"), F.max("is_head").alias("__head"),
        F.min(F.when(F.col("__content"), F.col("page_number"))).alias("p0"), F.max(F.when(F.col("__content"), F.col("page_end"))).alias("p1"),
    )
    return grouped.where("__head OR paragraph_count > 0").drop("__head")


def chapters(assigned: DataFrame) -> DataFrame:
    """One row for each chapter, empty ones included: book_id, chapter_order, title, paragraph_count."""
    return chapter_spans(assigned).drop("p0", "p1")


def assemble(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters, paragraphs and fragments of all books, from the lines of their pages.

    Marked lines and paragraphs are written once, to the shared folder and by book, and read by all three: lines are shuffled once.
    """
    from foliomill.operators.lines import join_hyphenated, remove_headers_and_footers

    folder = shared_folder(lines.sparkSession)
    marked = saved_by(mark_breaks(join_hyphenated(remove_headers_and_footers(lines))), folder, "lines", "book_id")
    paras = saved_by(merge_paragraphs(marked), folder, "paragraphs", "book_id")
    assigned = assign_chapters(merge_across_pages(paras))
    return chapters(assigned), chapter_paragraphs(assigned), merged_fragments(source_fragments(marked), paras)
