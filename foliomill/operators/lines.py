"""Operators on the lines of pages.

Lines are rows: book_id, page_number, line_idx (order in the book), text, x1, y1, x2, y2, confidence, page_w, page_h.
Every operator is keyed by book_id, so one exchange on it serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.rounding import py_round, py_round_once
from foliomill.functions.text import joins_by_hyphen, needs_space, strip, strip_left, strip_right

BOX = ("x1", "y1", "x2", "y2")


def relative_height(page_h: Column) -> Column:
    """Vertical centre as a share of the page, to one place."""
    return py_round((F.col("y1") + F.col("y2")) / 2 / F.when(F.coalesce(page_h, F.lit(0.0)) == 0, 1.0).otherwise(page_h), 1)


def remove_headers_and_footers(lines: DataFrame) -> DataFrame:
    """Drop texts that recur at one height near the page edges, and page numbers.

    Only books of five lines and three pages or more are touched. A text goes if it is on two pages (three in books of
    over five pages) and on 40 % of them.
    """
    book = W.partitionBy("book_id")
    seen = lines.withColumns(
        {
            "__rel": relative_height(F.col("page_h")),
            "__norm": F.lower(strip(F.col("text"))),
            "__n": F.count(F.lit(1)).over(book),
            "__pages": F.size(F.collect_set("page_number").over(book)),
        }
    )
    edge = (F.col("__rel") <= 0.15) | (F.col("__rel") >= 0.88)
    known = W.partitionBy("book_id", "__rel", "__norm")
    on_pages = F.size(F.collect_set("page_number").over(known))
    least = F.when(F.col("__pages") <= 5, F.greatest(F.lit(2), F.floor(F.col("__pages") * 0.45))).otherwise(3)
    recurs = edge & (F.col("__norm") != "") & (on_pages >= least) & (on_pages / F.col("__pages") >= 0.40)
    number = strip(F.col("text")).rlike(r"^\p{Nd}{1,5}$") & ((F.col("__rel") < 0.10) | (F.col("__rel") > 0.88))
    eligible = (F.col("__n") >= 5) & (F.col("__pages") >= 3)
    marked = seen.withColumn("__gone", eligible & (recurs | number))
    return marked.where("NOT __gone").select(lines.columns)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Add `read_idx`: place of a block on its page; the left of two columns comes first.

    A page has two columns if it has over three blocks and the widest gap between neighbouring x-centres exceeds 15 % of its
    right edge; the first of equal gaps counts.
    """
    page = W.partitionBy("book_id", "page_number")
    centred = blocks.withColumn("__c", (F.col("x1") + F.col("x2")) / 2)
    gaps = centred.withColumns({"__next": F.lead("__c").over(page.orderBy("__c")), "__right": F.max("x2").over(page), "__n": F.count(F.lit(1)).over(page)})
    gaps = gaps.withColumn("__gap", F.col("__next") - F.col("__c"))
    widest = gaps.withColumn("__best", F.max(F.struct(F.col("__gap"), -F.col("__c"), F.col("__next"))).over(page))
    split = (F.col("__n") > 3) & (F.col("__best")["__gap"] > F.col("__right") * 0.15)
    middle = (-F.col("__best")["col2"] + F.col("__best")["__next"]) / 2
    columned = widest.withColumn("__col", F.when(split & (F.col("__c") >= middle), 1).otherwise(0))
    return columned.withColumn("read_idx", F.row_number().over(page.orderBy("__col", "y1", "x1", "line_idx")) - 1).select(*blocks.columns, "read_idx")


def merge_same_line(blocks: DataFrame) -> DataFrame:
    """Join the boxes of a page that stand on one line.

    Boxes go, by height, to the first group whose first box is within 0.4 median heights. That depends on the groups
    made so far, so the boxes of a page are one array (a page is bounded) and each takes its group from the centres before it.
    """
    filled = blocks.select(_LINE_COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))
    box = F.struct("y1", "line_idx", "x1", "x2", "y2", "text", "confidence", "page_w", "page_h")
    pages = filled.groupBy("book_id", "page_number").agg((F.median(F.col("y2") - F.col("y1")) * 0.4).alias("near"), F.array_sort(F.collect_list(box)).alias("boxes"))

    def place(state: Column, b: Column) -> Column:
        centre = (b["y1"] + b["y2"]) / 2
        home = F.array_position(F.transform(state["seeds"], lambda s: F.abs(centre - s) < F.col("near")), True)
        own = F.when(home > 0, home.cast("int") - 1).otherwise(F.size(state["seeds"]))
        seeds = F.when(home > 0, state["seeds"]).otherwise(F.concat(state["seeds"], F.array(centre)))
        return F.struct(seeds.alias("seeds"), F.concat(state["own"], F.array(own)).alias("own"))

    nothing = F.struct(F.array().cast("array<double>").alias("seeds"), F.array().cast("array<int>").alias("own"))
    placed = pages.select("book_id", "page_number", "boxes", F.aggregate("boxes", nothing, place, lambda s: s["own"]).alias("own"))
    members = placed.select("book_id", "page_number", F.posexplode(F.arrays_zip("boxes", "own")).alias("at", "b"))
    own = F.array_sort(F.collect_list(F.struct("b.boxes.x1", "at", "b.boxes.text", "b.boxes.x2", "b.boxes.y1", "b.boxes.y2", "b.boxes.confidence", "b.boxes.page_w", "b.boxes.page_h")))
    groups = members.groupBy("book_id", "page_number", F.col("b.own").cast("long").alias("line_idx")).agg(own.alias("m"))
    spaced = F.transform("m", lambda b, i: F.concat(F.when((i > 0) & _apart(F.get(F.col("m"), i - 1), b), " ").otherwise(""), b["text"]))
    total = F.aggregate("m", F.lit(0), lambda n, b: n + F.length(b["text"]))
    weight = F.aggregate("m", F.lit(0.0), lambda w, b: w + b["confidence"] * F.length(b["text"]))
    first = F.element_at("m", 1)
    corners = {"x1": F.array_min("m.x1"), "y1": F.array_min("m.y1"), "x2": F.array_max("m.x2"), "y2": F.array_max("m.y2")}
    made = {"text": F.array_join(spaced, ""), **corners, "confidence": F.when(total > 0, py_round_once(weight / F.when(total > 0, total), 4)).otherwise(0.0), "page_w": first["page_w"], "page_h": first["page_h"]}
    return groups.withColumns(made).select(_LINE_COLUMNS)


def _apart(before: Column, after: Column) -> Column:
    """Whether two neighbouring boxes of one line are words apart."""
    width = F.greatest((after["y2"] - after["y1"]) * 0.5, F.lit(4.0))
    return F.coalesce(needs_space(before["text"], after["text"], after["x1"] - before["x2"], width), F.lit(False))


_LINE_COLUMNS = ["book_id", "page_number", "line_idx", "text", *BOX, "confidence", "page_w", "page_h"]


def join_hyphenated(lines: DataFrame) -> DataFrame:
    """Join lines that end in a hyphen with the next one of the same or next page, where the parts surely are one word.

    A joined line may join the next one in turn, with the page of its first part, so whether two lines join depends on the
    lines before them. But a line that does not follow a hyphen, begins with no small letter or stands more than a page further joins nothing,
    whatever came before: it starts anew. These lines cut a book into short stretches, found by one window, and only inside of a
    stretch one line after another is folded, in the plan. Nearly all stretches are single lines. Lines without text or page join nothing.
    """
    book = W.partitionBy("book_id").orderBy("line_idx")
    text = F.coalesce(F.col("text"), F.lit(""))
    follows = strip_right(F.lag(text).over(book)).endswith("-") & strip_left(text).rlike(r"^\p{Ll}") & (F.col("page_number") - F.lag("page_number").over(book)).isin(0, 1)
    marked = lines.select(_LINE_COLUMNS).withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    stretches = marked.withColumn("__stretch", F.sum("__new").over(book.rowsBetween(W.unboundedPreceding, 0)))
    own = [c for c in _LINE_COLUMNS if c != "book_id"]
    parts = stretches.groupBy("book_id", "__stretch").agg(F.array_sort(F.collect_list(F.struct("line_idx", *[c for c in own if c != "line_idx"]))).alias("parts"))
    one = F.element_at("parts", 1)
    # A stretch ends with the lines that are done and the one that may still grow.
    empty = F.filter("parts", lambda p: F.lit(False))
    folded = F.aggregate(F.slice("parts", 2, F.size("parts")), F.struct(empty.alias("done"), one.alias("head")), _take_line, lambda a: F.concat(a["done"], F.array(a["head"])))
    joined = parts.select("book_id", F.inline(F.when(F.size("parts") == 1, F.col("parts")).otherwise(folded)))
    return joined.select(_LINE_COLUMNS)


def _take_line(state: Column, line: Column) -> Column:
    """(done, head) after one more line: it continues the head's last word, or begins a head of its own."""
    head = state["head"]
    body, second = strip_right(F.coalesce(head["text"], F.lit(""))), strip_left(F.coalesce(line["text"], F.lit("")))
    first = strip(F.substring(body, F.lit(1), F.length(body) - 1))
    near = (line["page_number"] - head["page_number"]).isin(0, 1)
    fits = F.coalesce(body.endswith("-") & second.rlike(r"^\p{Ll}") & near & joins_by_hyphen(first, second), F.lit(False))
    weight = head["confidence"] * F.length(first) + line["confidence"] * F.length(second)
    grown = {
        "text": F.concat(first, second),
        "confidence": py_round(weight / (F.length(first) + F.length(second)), 4),
        "x2": F.greatest(head["x2"], line["x2"]),
        "y2": F.greatest(head["y2"], line["y2"]),
    }
    fields = ["line_idx", *[c for c in _LINE_COLUMNS if c not in ("book_id", "line_idx")]]
    whole = F.struct(*[grown.get(c, head[c]).alias(c) for c in fields])
    return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(head))).alias("done"), F.when(fits, whole).otherwise(line).alias("head"))


def weighted_confidence(confidence: Column, text: Column) -> Column:
    """Aggregate: mean confidence by text length, 0 for no text."""
    total = F.sum(F.length(text))
    return F.when(total > 0, F.sum(confidence * F.length(text)) / total).otherwise(0.0)


def native_lines(blocks: DataFrame, dpi: int = 200) -> DataFrame:
    """Text lines of page blocks in points, as pixels: book_id, page_number, page_w, page_h (points), blocks array.

    Blocks of type 0 hold lines of spans; spans are joined, stripped, and dropped below two characters.
    """
    scale = dpi / 72
    line = blocks.select("book_id", "page_number", "page_w", "page_h", F.posexplode("blocks").alias("__b", "block")).where("block.type = 0")
    line = line.select("book_id", "page_number", "page_w", "page_h", "__b", F.posexplode("block.lines").alias("__l", "line"))
    text = strip(F.array_join(F.transform("line.spans", lambda s: s["text"]), ""))
    boxes = {c: (F.element_at("line.bbox", i + 1) * scale) for i, c in enumerate(BOX)}
    made = line.withColumns({"text": text, **boxes, "confidence": F.lit(1.0), "page_w": F.col("page_w") * scale, "page_h": F.col("page_h") * scale})
    order = W.partitionBy("book_id", "page_number").orderBy("__b", "__l")
    return made.where(F.length("text") >= 2).withColumn("line_idx", (F.row_number().over(order) - 1).cast("long")).select(_LINE_COLUMNS)


def ocr_lines(raw: DataFrame) -> DataFrame:
    """Boxes of recognised text: (book_id, page_number, seq, pts: corner points, text, conf, page_w, page_h) as lines, without garbage."""
    from foliomill.functions.text import is_garbage

    xs, ys = F.transform("pts", lambda p: p[0]), F.transform("pts", lambda p: p[1])
    boxes = {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}
    made = raw.where(F.size("pts") > 0).withColumns({**boxes, "text": strip(F.col("text")), "confidence": F.col("conf").cast("double"), "line_idx": F.col("seq").cast("long")})
    return made.where(~is_garbage(F.col("text"))).select(_LINE_COLUMNS)


def rescale(lines: DataFrame, dpi: Column | int, to: int = 200) -> DataFrame:
    """Boxes that were read at another resolution, in pixels of `to` dots an inch; a null or zero resolution leaves them as they are."""
    dots = (F.lit(dpi) if isinstance(dpi, int) else dpi).cast("double")
    factor = F.when(dots > 0, to / dots).otherwise(1.0)
    return lines.withColumns({c: F.col(c) * factor for c in BOX})


def with_page_sizes(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """page_w and page_h of each line from its page's row (book_id, page_number, width, height), as whole numbers; null for pages without one.

    Stages after this take an unknown height for 1 and skip rules that need an unknown width. Of several rows of a page the largest counts.
    """
    whole = lambda c: F.floor(F.max(c)).cast("double")
    sizes = pages.groupBy("book_id", "page_number").agg(whole("width").alias("page_w"), whole("height").alias("page_h"))
    return lines.drop("page_w", "page_h").join(sizes, ["book_id", "page_number"], "left").select(*lines.columns)


def recognise(pages: DataFrame, engine, image: str = "image") -> DataFrame:
    """Run a recognition engine over page images: engine() gives a function from bytes to (points, text, confidence) entries.

    The engine is made once for each task; a page that it fails on has no entries.
    """
    names = ["book_id", "page_number", "page_w", "page_h"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for batch in batches:
            read = read or engine()
            out = []
            for row in batch.itertuples(index=False):
                try:
                    found = list(read(getattr(row, image)))
                except Exception:  # the engine is foreign code: its failure is a page without text
                    found = []
                out += [(*(getattr(row, n) for n in names), i, e[0], e[1], float(e[2])) for i, e in enumerate(found) if len(e) >= 3]
            yield pd.DataFrame(out, columns=[*names, "seq", "pts", "text", "conf"])

    return pages.select(*names, image).mapInPandas(run, "book_id long, page_number int, page_w double, page_h double, seq int, pts array<array<double>>, text string, conf double")
