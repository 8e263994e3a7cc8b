"""Page text quality: the gate for native text, scores, and the choice between two recognitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import meaningful_ratio, non_space_count, replacement_ratio


def native_text_passes(text: Column) -> Column:
    """40 characters or more, mostly readable, few replacement signs; or 10 to 39, very readable and none."""
    n, good, bad = non_space_count(text), meaningful_ratio(text), replacement_ratio(text)
    return ((n >= 40) & (good >= 0.55) & (bad <= 0.02)) | (n.between(10, 39) & (good >= 0.8) & (bad == 0))


def quality_score(weighted: Column, ratio: Column, n_chars: Column, n_lines: Column) -> Column:
    return weighted * 0.35 + ratio * 0.30 + F.least(n_chars / 500.0, F.lit(1.0)) * 0.25 + F.least(n_lines / 30.0, F.lit(0.3))


def needs_retry(n_chars: Column, ratio: Column, weighted: Column, n_lines: Column) -> Column:
    return F.when((n_chars == 0) & (n_lines == 0), True).when(n_chars == 0, False).otherwise((ratio < 0.5) | (weighted < 0.65) | ((n_chars < 80) & (weighted < 0.75)))


def choose_recognition(pages: DataFrame) -> DataFrame:
    """One row for each page: the retry only if its score is strictly higher.

    pages: book_id, page_number, score (of the first try, null if it failed), retry_score (null if there was none).
    """
    better = F.coalesce(F.col("retry_score") > F.col("score"), F.lit(False))
    return pages.withColumns({"chosen": F.when(F.col("score").isNull(), "failed").when(better, "retry").otherwise("first"), "best_score": F.when(F.col("score").isNull(), 0.0).when(better, F.col("retry_score")).otherwise(F.col("score"))})


def page_quality(lines: DataFrame) -> DataFrame:
    """Measures of each page: raw text, weighted confidence, meaningful ratio, counts, score and retry."""
    from foliomill.operators.lines import weighted_confidence

    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n")
    pages = lines.groupBy("book_id", "page_number").agg(raw.alias("raw_text"), weighted_confidence(F.col("confidence"), F.col("text")).alias("weighted_conf"), F.count(F.lit(1)).alias("n_lines"))
    measured = pages.withColumns({"n_chars": non_space_count(F.col("raw_text")), "ratio": meaningful_ratio(F.col("raw_text"))})
    return measured.withColumns(
        {"score": quality_score(F.col("weighted_conf"), F.col("ratio"), F.length("raw_text"), F.col("n_lines")), "needs_retry": needs_retry(F.col("n_chars"), F.col("ratio"), F.col("weighted_conf"), F.col("n_lines"))}
    )
