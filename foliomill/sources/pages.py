"""Stored page results: JSON lines to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_TYPE = "array<struct<text:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,page_number:int>>"


def to_page_rows(lines: DataFrame) -> DataFrame:
    """One row for each page, its lines as JSON: book_id, page_number, width, height, lines_json, status."""
    line = F.struct("line_idx", F.struct("text", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "confidence", "page_number").alias("line"))
    packed = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return lines.groupBy("book_id", "page_number").agg(F.first("page_w").alias("width"), F.first("page_h").alias("height"), F.to_json(packed).alias("lines_json")).withColumn("status", F.lit("completed"))


def from_page_rows(pages: DataFrame) -> DataFrame:
    """Lines of completed pages with at least one line; what is no JSON array has none."""
    lines = F.coalesce(F.from_json("lines_json", LINES_TYPE), F.expr(f"cast(array() as {LINES_TYPE})"))
    parsed = pages.where("status = 'completed'").withColumn("lines", lines).where(F.size("lines") > 0)
    return parsed.select("book_id", "page_number", F.posexplode("lines").alias("line_idx", "l"), "width", "height").select(
        "book_id", "page_number", F.col("line_idx").cast("long").alias("line_idx"), F.col("l.text").alias("text"), "l.bbox.x1", "l.bbox.y1", "l.bbox.x2", "l.bbox.y2", F.col("l.confidence").alias("confidence"), F.floor("width").cast("double").alias("page_w"), F.floor("height").cast("double").alias("page_h")
    )
