"""Queries over lines, paragraphs, fragments and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.text import PREFIXES, PUNCTUATION_ONLY, SUFFIXES, camel_split, clean_pdf_text, html_escape, is_garbage, joins_by_hyphen, meaningful_ratio, normalise_for_match, replacement_ratio
from foliomill.operators import lines as L
from foliomill.operators import paragraphs as P
from foliomill.operators import quality as Q
from foliomill.plans import fixtures as X
from foliomill.sources.pages import from_page_rows, to_page_rows

_BOX = "x1, y1, x2, y2"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, ' {{2,}}', ' ', 'g'), '\s+([,.:;!?)\]}}>%])', '\1', 'g'), '([\[({{¿¡])\s+', '\1', 'g'))"


def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return X.page_lines(spark, d).select("book_id", "page_number", "line_idx", "text", "x1", "y1", "x2", "y2", "confidence")


def pages_completed(spark: SparkSession, d: str) -> DataFrame:
    rows = to_page_rows(X.page_lines(spark, d)).withColumn("status", F.when(F.col("page_number") % 7 == 0, "failed").otherwise(F.col("status")))
    return from_page_rows(rows).groupBy("book_id").agg(F.countDistinct("page_number").alias("n_pages"), F.count(F.lit(1)).alias("n_lines"))


def lines_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = from_page_rows(to_page_rows(X.page_lines(spark, d)))
    return back.select("book_id", "page_number", "line_idx", "text", "x1", "y1", "x2", "y2", "confidence")


def native_text_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", Q.native_text_passes(F.col("text")).alias("passes"), F.round(meaningful_ratio(F.col("text")), 9).alias("ratio"), F.round(replacement_ratio(F.col("text")), 9).alias("bad_ratio"))


def garbage_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = X.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"[\p{L}\p{Nd}]+")).alias("part", "piece"))
    return parts.withColumn("garbage", is_garbage(F.col("piece"))).groupBy("doc_id").agg(F.count_if("garbage").alias("n_garbage"), F.count(F.lit(1)).alias("n_parts"))


def ocr_quality_score(spark: SparkSession, d: str) -> DataFrame:
    q = Q.page_quality(X.page_lines(spark, d))
    return q.select("book_id", "page_number", F.round("weighted_conf", 9).alias("weighted_conf"), F.round("ratio", 9).alias("ratio"), F.col("n_chars").cast("long").alias("n_chars"), F.round("score", 9).alias("score"), "needs_retry")


def ocr_retry_choice(spark: SparkSession, d: str) -> DataFrame:
    """The next page of the book stands for a page's second try; the last page has none."""
    q = Q.page_quality(X.page_lines(spark, d)).select("book_id", "page_number", F.round("score", 9).alias("score"))
    tried = q.withColumn("retry_score", F.lead("score").over(W.partitionBy("book_id").orderBy("page_number")))
    return Q.choose_recognition(tried).select("book_id", "page_number", "chosen", "best_score")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    blocks = X.body_lines(spark, d).withColumns({"x1": F.col("x1") + F.when(F.col("line_idx") % 2 == 0, 900.0).otherwise(0.0), "x2": F.col("x2") + F.when(F.col("line_idx") % 2 == 0, 900.0).otherwise(0.0)})
    return L.reading_order(blocks).select("book_id", "page_number", "line_idx", F.col("read_idx").cast("int").alias("read_idx"))


def same_line_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every second line is set beside the one before it."""
    odd = F.col("line_idx") % 2 == 0
    blocks = X.body_lines(spark, d).withColumns({"y1": F.col("y1") - F.when(odd, 40.0).otherwise(0.0), "y2": F.col("y2") - F.when(odd, 40.0).otherwise(0.0), "x1": F.col("x1") + F.when(odd, 1400.0).otherwise(0.0), "x2": F.col("x2") + F.when(odd, 1400.0).otherwise(0.0)})
    return L.merge_same_line(blocks)


def header_footer_clean(spark: SparkSession, d: str) -> DataFrame:
    return L.remove_headers_and_footers(X.page_lines(spark, d)).select("book_id", "page_number", "line_idx", "text")


def hyphen_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.join_hyphenated(X.body_lines(spark, d))


def hyphen_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("book_id").orderBy("line_idx")
    pairs = X.body_lines(spark, d).withColumn("before", F.lag("text").over(order)).where("before LIKE '%-'")
    first = F.trim(F.expr("substring(before, 1, length(before) - 1)"))
    return pairs.select("book_id", "line_idx", joins_by_hyphen(first, F.col("text")).alias("joins"))


def paragraph_breaks(spark: SparkSession, d: str) -> DataFrame:
    return P.mark_breaks(X.body_lines(spark, d)).select("book_id", "line_idx", "is_break", "para_idx", "centred")


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_paragraphs(P.mark_breaks(X.body_lines(spark, d)))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _paras(spark, d).select("book_id", "para_idx", "text", "page_number", "page_end", "confidence", "is_centred", "n_lines")


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return P.source_fragments(P.mark_breaks(X.body_lines(spark, d)))


def source_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _fragments(spark, d).select("book_id", "para_idx", "fragment_order", "pdf_page_index", "x1", "y1", "x2", "y2", "source_text", "confidence")


def bbox_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _fragments(spark, d).select("book_id", "para_idx", "fragment_order", "norm_x1", "norm_y1", "norm_x2", "norm_y2")


FRAGMENTS_SQL = """,
frag_gaps AS (SELECT *, coalesce(lag(y2 - y1) OVER w > 0 AND y1 - lag(y2) OVER w > lag(y2 - y1) OVER w * 1.5, FALSE) AS apart FROM marked WINDOW w AS (PARTITION BY book_id, para_idx, page_number ORDER BY y1, line_idx)),
frag_parts AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, para_idx, page_number ORDER BY y1, line_idx) AS part FROM frag_gaps),
frags AS (SELECT book_id, para_idx, page_number, CAST(row_number() OVER (PARTITION BY book_id, para_idx ORDER BY page_number, part) - 1 AS INT) AS fragment_order, CAST(page_number - 1 AS INT) AS pdf_page_index,
    x1, y1, x2, y2, source_text, confidence
  FROM (SELECT book_id, para_idx, page_number, part, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(trim(text), ' ' ORDER BY y1, line_idx) AS source_text,
      CAST(format('{:.4f}', sum(confidence * length(text)) / sum(length(text))) AS DOUBLE) AS confidence FROM frag_parts GROUP BY ALL))"""

BREAKS = "WITH " + X.BODY_SQL + X.BREAKS_SQL.replace("{source}", "body")


def cross_page_merge(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_across_pages(_paras(spark, d)).select("book_id", "para_idx", "text", "page_number", "page_end", "is_centred", "n_merged", "confidence")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return P.assign_chapters(P.merge_across_pages(_paras(spark, d)))


def chapters_detected(spark: SparkSession, d: str) -> DataFrame:
    return P.chapters(assigned(spark, d))


def chapter_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return P.chapter_paragraphs(assigned(spark, d)).select("book_id", "chapter_order", "paragraph_order", "title", "text", "html", "page_number", "page_end")


def assemble_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """All stages over lines with headers and footers: chapters with their paragraphs and numbers of fragments.

    A chapter without paragraphs is one row of paragraph_order -1.
    """
    chapters, paras, frags = P.assemble(X.page_lines(spark, d))
    per_para = frags.groupBy("book_id", "para_idx").agg(F.count(F.lit(1)).cast("int").alias("n_fragments"))
    joined = paras.join(per_para, ["book_id", "para_idx"], "left")
    whole = chapters.join(joined.drop("title"), ["book_id", "chapter_order"], "left").withColumn("paragraph_order", F.coalesce("paragraph_order", F.lit(-1)))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("page_number", "page_end", "confidence", "n_fragments")]
    return whole.select("book_id", "chapter_order", "title", "paragraph_count", "paragraph_order", "text", *numbers)


def clean_text_pdf(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", clean_pdf_text(F.col("text")).alias("clean"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "conversations").select("conv_id", "turn", normalise_for_match(F.col("text")).alias("norm"))


def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", html_escape(F.col("text")).alias("escaped"), camel_split(F.col("text")).alias("split_words"))


def native_lines_px(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text blocks in points, as pixels; each line comes as two spans, every block of images is skipped."""
    lines = X.body_lines(spark, d)
    cut = F.floor(F.length("text") / 2).cast("int")
    spans = F.array(F.struct(F.substring("text", F.lit(1), cut).alias("text")), F.struct(F.substring("text", cut + 1, F.length("text")).alias("text")))
    line = F.struct("line_idx", spans.alias("spans"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
    pages = lines.groupBy("book_id", "page_number", "page_w", "page_h").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    blocks = F.array(F.struct(F.lit(0).alias("type"), "lines"), F.struct(F.lit(1).alias("type"), F.col("lines").alias("lines")))
    return L.native_lines(pages.select("book_id", "page_number", "page_w", "page_h", blocks.alias("blocks"))).select("book_id", "page_number", "line_idx", "text", "x1", "y2", "page_w")


def ocr_lines_kept(spark: SparkSession, d: str) -> DataFrame:
    """Recognised boxes as lines; every seventh is garbage, every eleventh has no corners."""
    at = lambda x, y: F.array(F.col(x), F.col(y))
    corners = F.when(F.col("line_idx") % 11 == 0, F.expr("cast(array() as array<array<double>>)")).otherwise(F.array(at("x2", "y1"), at("x1", "y1"), at("x1", "y2"), at("x2", "y2")))
    text = F.when(F.col("line_idx") % 7 == 0, " —· … ").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    raw = X.body_lines(spark, d).select("book_id", "page_number", F.col("line_idx").cast("int").alias("seq"), corners.alias("pts"), text.alias("text"), F.col("confidence").alias("conf"), "page_w", "page_h")
    return L.ocr_lines(raw).select("book_id", "page_number", "line_idx", "text", "x1", "y1", "x2", "y2", "confidence")


def dpi_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Pages read a second time at 260 dots an inch, in pixels of 200."""
    page = F.col("page_number")
    dpi = F.when(page % 3 == 0, 260).when(page % 3 == 1, 200)
    return L.rescale(X.body_lines(spark, d), dpi).select("book_id", "line_idx", "x1", "y1", "x2", "y2")


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the size of their page; every fourth page has no row."""
    lines = X.body_lines(spark, d)
    pages = lines.where("page_number % 4 > 0").select("book_id", "page_number", (F.col("page_w") + F.col("page_number") + 0.7).alias("width"), "page_h").withColumnRenamed("page_h", "height").distinct()
    sized = L.with_page_sizes(lines, pages)
    return sized.select("book_id", "line_idx", F.coalesce("page_w", F.lit(-1.0)).alias("page_w"), F.coalesce("page_h", F.lit(-1.0)).alias("page_h"))


QUERIES = {
    "native_lines_px": native_lines_px, "ocr_lines_kept": ocr_lines_kept, "dpi_rescale": dpi_rescale, "page_sizes": page_sizes,
    "lines_explode": lines_explode, "pages_completed": pages_completed, "lines_json_roundtrip": lines_json_roundtrip, "native_text_gate": native_text_gate, "garbage_lines": garbage_lines,
    "ocr_quality_score": ocr_quality_score, "ocr_retry_choice": ocr_retry_choice, "reading_order": reading_order, "same_line_merge": same_line_merge, "header_footer_clean": header_footer_clean,
    "hyphen_merge": hyphen_merge, "hyphen_merge_pairs": hyphen_merge_pairs, "paragraph_breaks": paragraph_breaks, "paragraphs": paragraphs, "source_fragments": source_fragments,
    "bbox_normalized": bbox_normalized, "cross_page_merge": cross_page_merge, "chapters_detected": chapters_detected, "chapter_paragraphs": chapter_paragraphs,
    "assemble_end_to_end": assemble_end_to_end, "clean_text_pdf": clean_text_pdf, "normalize_text": normalize_text, "html_escape": html_escaped,
}

_MEANING = r"length(regexp_replace(text, '[^\p{L}\p{N}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g'))"
_SPACELESS = r"length(regexp_replace(text, '[\s\x{A0}\x{0B}]', '', 'g'))"

_QUALITY_SQL = "WITH " + X.LINES_SQL + f""",
raw AS (SELECT book_id, page_number, string_agg(text, chr(10) ORDER BY line_idx) AS text, sum(confidence * length(text)) / sum(length(text)) AS wc, count(*) AS n_lines FROM lines GROUP BY ALL),
m AS (SELECT *, {_SPACELESS} AS n, {_MEANING} / {_SPACELESS} AS ratio FROM raw),
q AS (SELECT *, wc * 0.35 + ratio * 0.30 + least(length(text) / 500.0, 1.0) * 0.25 + least(n_lines / 30.0, 0.3) AS score FROM m)"""

_GARBAGE = PUNCTUATION_ONLY.replace("'", "''")
_PREFIX_LIST = ", ".join(f"'{x}'" for x in PREFIXES)
_SUFFIX_LIST = ", ".join(f"'{x}'" for x in SUFFIXES)

ORACLES = {
    "lines_explode": f"WITH {X.LINES_SQL} SELECT book_id, page_number, line_idx, text, {_BOX}, confidence FROM lines",
    "pages_completed": f"WITH {X.LINES_SQL} SELECT book_id, count(DISTINCT page_number) AS n_pages, count(*) AS n_lines FROM lines WHERE page_number % 7 <> 0 GROUP BY book_id",
    "lines_json_roundtrip": f"WITH {X.LINES_SQL} SELECT book_id, page_number, CAST(row_number() OVER (PARTITION BY book_id, page_number ORDER BY line_idx) - 1 AS BIGINT) AS line_idx, text, {_BOX}, confidence FROM lines",
    "native_text_gate": f"""WITH m AS (SELECT doc_id, text, {_SPACELESS} AS n, {_MEANING} AS good, length(text) - length(replace(text, chr(65533), '')) AS bad FROM documents),
r AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0.0 ELSE good / n END AS ratio, CASE WHEN n = 0 THEN 0.0 ELSE bad / n END AS bad_ratio FROM m)
SELECT doc_id, (n >= 40 AND ratio >= 0.55 AND bad_ratio <= 0.02) OR (n BETWEEN 10 AND 39 AND ratio >= 0.8 AND bad_ratio = 0) AS passes, round(ratio, 9) AS ratio, round(bad_ratio, 9) AS bad_ratio FROM r""",
    "garbage_lines": r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\p{L}\p{Nd}]+')) AS piece FROM documents)
SELECT doc_id, count(*) FILTER (trim(regexp_replace(piece, '\s', ' ', 'g')) = '' OR regexp_matches(piece, '^[\s\-–—•·\x{202F}\x{FEFF}.,;:!?"''‘()\[\]{}<>«»‥…・《》、，。；：？！【】「-』〔〕]+$')) AS n_garbage, count(*) AS n_parts FROM p GROUP BY doc_id""",
    "ocr_quality_score": _QUALITY_SQL + " SELECT book_id, page_number, round(wc, 9) AS weighted_conf, round(ratio, 9) AS ratio, n AS n_chars, round(score, 9) AS score, ratio < 0.5 OR wc < 0.65 OR (n < 80 AND wc < 0.75) AS needs_retry FROM q",
    "ocr_retry_choice": _QUALITY_SQL + """, p AS (SELECT book_id, page_number, round(score, 9) AS s1, lead(round(score, 9)) OVER (PARTITION BY book_id ORDER BY page_number) AS s2 FROM q)
SELECT book_id, page_number, CASE WHEN s1 IS NULL THEN 'failed' WHEN s2 > s1 THEN 'retry' ELSE 'first' END AS chosen, CASE WHEN s1 IS NULL THEN 0.0 WHEN s2 > s1 THEN s2 ELSE s1 END AS best_score FROM p""",
    "reading_order": f"""WITH {X.BODY_SQL},
b AS (SELECT book_id, page_number, line_idx, y1, x1 + CASE WHEN line_idx % 2 = 0 THEN 900.0 ELSE 0.0 END AS x1, x2 + CASE WHEN line_idx % 2 = 0 THEN 900.0 ELSE 0.0 END AS x2 FROM body),
c AS (SELECT *, (x1 + x2) / 2 AS c, max(x2) OVER p AS rt, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY book_id, page_number)),
g AS (SELECT *, lead(c) OVER (PARTITION BY book_id, page_number ORDER BY c) AS nx FROM c),
w AS (SELECT book_id, page_number, arg_max(c, (nx - c, -c)) AS lo, max(nx - c) AS gap FROM g WHERE nx IS NOT NULL GROUP BY ALL),
s AS (SELECT g.*, CASE WHEN n > 3 AND gap > rt * 0.15 AND c >= (lo + lo + gap) / 2 THEN 1 ELSE 0 END AS col FROM g LEFT JOIN w USING (book_id, page_number))
SELECT book_id, page_number, line_idx, CAST(row_number() OVER (PARTITION BY book_id, page_number ORDER BY col, y1, x1, line_idx) - 1 AS INT) AS read_idx FROM s""",
    "header_footer_clean": f"WITH {X.CLEAN_SQL} SELECT book_id, page_number, line_idx, text FROM clean",
    "same_line_merge": rf"""WITH RECURSIVE {X.BODY_SQL},
boxes AS (SELECT * REPLACE (CASE WHEN line_idx % 2 = 0 THEN y1 - 40 ELSE y1 END AS y1, CASE WHEN line_idx % 2 = 0 THEN y2 - 40 ELSE y2 END AS y2, CASE WHEN line_idx % 2 = 0 THEN x1 + 1400 ELSE x1 END AS x1, CASE WHEN line_idx % 2 = 0 THEN x2 + 1400 ELSE x2 END AS x2) FROM body),
numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_number ORDER BY y1, line_idx) AS r, median(y2 - y1) OVER (PARTITION BY book_id, page_number) * 0.4 AS near FROM boxes),
walk AS (
  SELECT book_id, page_number, r, [(y1 + y2) / 2] AS seeds, 1 AS own FROM numbered WHERE r = 1
  UNION ALL
  SELECT book_id, page_number, r, CASE WHEN home > 0 THEN seeds ELSE list_append(seeds, centre) END, CAST(CASE WHEN home > 0 THEN home ELSE len(seeds) + 1 END AS INT)
  FROM (SELECT n.book_id, n.page_number, n.r, w.seeds, (n.y1 + n.y2) / 2 AS centre, coalesce(list_position(list_transform(w.seeds, lambda s: abs((n.y1 + n.y2) / 2 - s) < n.near), TRUE), 0) AS home
    FROM walk w JOIN numbered n ON n.book_id = w.book_id AND n.page_number = w.page_number AND n.r = w.r + 1)),
placed AS (SELECT n.*, own, lag(text) OVER o AS pt, lag(x2) OVER o AS px2 FROM numbered n JOIN walk USING (book_id, page_number, r) WINDOW o AS (PARTITION BY n.book_id, n.page_number, own ORDER BY x1, r)),
spaced AS (SELECT *, CASE WHEN pt <> '' AND text <> '' AND pt NOT LIKE '%-' AND NOT regexp_matches(text, '^[,.:;!?)\]}}%>]') AND x1 - px2 >= greatest((y2 - y1) * 0.5, 4.0) * 0.5 THEN ' ' ELSE '' END || text AS piece FROM placed)
SELECT book_id, page_number, CAST(own - 1 AS BIGINT) AS line_idx, string_agg(piece, '' ORDER BY x1, r) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
  CASE WHEN sum(length(text)) > 0 THEN CAST(format('{{:.4f}}', sum(confidence * length(text)) / sum(length(text))) AS DOUBLE) ELSE 0.0 END AS confidence, first(page_w) AS page_w, first(page_h) AS page_h
FROM spaced GROUP BY book_id, page_number, own""",
    "assemble_end_to_end": f"""WITH RECURSIVE {X.CLEAN_SQL}, {X.hyphen_sql('clean')}{X.BREAKS_SQL.replace("{source}", "unhyphened")}{X.MERGES_SQL}{X.CHAPTERS_SQL.replace("{source}", "merged")}{FRAGMENTS_SQL},
moved AS (SELECT f.book_id, m.merge_idx AS para_idx, count(*) AS n_fragments FROM frags f JOIN merge_ids m USING (book_id, para_idx) GROUP BY ALL)
SELECT c.book_id, c.chapter_order, c.title, c.paragraph_count, coalesce(p.paragraph_order, -1) AS paragraph_order, p.text, coalesce(p.page_number, 0) AS page_number, coalesce(p.page_end, 0) AS page_end, coalesce(p.confidence, 0) AS confidence, CAST(coalesce(n_fragments, 0) AS INT) AS n_fragments
FROM chapters c LEFT JOIN content p ON p.book_id = c.book_id AND p.chapter_order = c.chapter_order LEFT JOIN moved f ON f.book_id = p.book_id AND f.para_idx = p.para_idx""",
    "hyphen_merge": f"WITH RECURSIVE {X.BODY_SQL}, {X.hyphen_sql('body')} SELECT * FROM unhyphened",
    "hyphen_merge_pairs": f"""WITH {X.BODY_SQL},
p AS (SELECT book_id, line_idx, text AS b, lag(text) OVER (PARTITION BY book_id ORDER BY line_idx) AS before FROM body),
q AS (SELECT book_id, line_idx, b, trim(substr(before, 1, length(before) - 1)) AS a FROM p WHERE before LIKE '%-')
SELECT book_id, line_idx, length(a) > 2 AND length(b) > 2 AND length(a) + length(b) >= 5 AND (lower(b) IN ({_SUFFIX_LIST}) OR lower(a) IN ({_PREFIX_LIST})
  OR (NOT regexp_matches(a, '^\\p{{Lu}}') AND NOT regexp_matches(b, '^\\p{{Lu}}') AND length(a) + length(b) >= 6)) AS joins FROM q""",
    "paragraph_breaks": BREAKS + " SELECT book_id, line_idx, is_break, para_idx, centred FROM marked",
    "paragraphs": BREAKS + " SELECT book_id, para_idx, text, page_number, page_end, confidence, is_centred, n_lines FROM paras",
    "source_fragments": BREAKS + FRAGMENTS_SQL + " SELECT book_id, para_idx, fragment_order, pdf_page_index, x1, y1, x2, y2, source_text, confidence FROM frags",
    "bbox_normalized": BREAKS + FRAGMENTS_SQL + " SELECT book_id, para_idx, fragment_order, round(x1 / 1700, 6) AS norm_x1, round(y1 / 2200, 6) AS norm_y1, round(x2 / 1700, 6) AS norm_x2, round(y2 / 2200, 6) AS norm_y2 FROM frags",
    "cross_page_merge": BREAKS + X.MERGES_SQL + " SELECT * FROM merged",
    "chapters_detected": f"WITH {X.STRUCTURE_SQL} SELECT * FROM chapters",
    "chapter_paragraphs": f"""WITH {X.STRUCTURE_SQL} SELECT book_id, chapter_order, paragraph_order, title, text,
  '<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>' AS html, page_number, page_end FROM content""",
    "clean_text_pdf": "SELECT doc_id, regexp_replace(" + _TEXT.format("text").removeprefix("trim(").removesuffix(")") + r", '^\s+|\s+$', '', 'g') AS clean FROM documents",
    "normalize_text": r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[-‐‑]', '', 'g'), '[^\p{L}\p{N}\p{Mn}\p{Mc}\p{Pc}\s]', '', 'g'), '^\s+|\s+$', '', 'g') AS norm FROM conversations""",
    "html_escape": """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  regexp_replace(text, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g') AS split_words FROM documents""",
    "native_lines_px": f"""WITH {X.BODY_SQL} SELECT book_id, page_number, row_number() OVER (PARTITION BY book_id, page_number ORDER BY line_idx) - 1 AS line_idx, t AS text, x1 * (200.0::DOUBLE / 72) AS x1, y2 * (200.0::DOUBLE / 72) AS y2, page_w * (200.0::DOUBLE / 72) AS page_w
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM body) WHERE length(t) >= 2""",
    "ocr_lines_kept": f"WITH {X.BODY_SQL} SELECT book_id, page_number, line_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, x1, y1, x2, y2, confidence FROM body WHERE line_idx % 7 > 0 AND line_idx % 11 > 0 AND NOT regexp_matches(text, '{_GARBAGE}')",
    "dpi_rescale": f"WITH {X.BODY_SQL}, f AS (SELECT *, CASE WHEN page_number % 3 = 0 THEN 200 / 260.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM body) SELECT book_id, line_idx, x1 * f AS x1, y1 * f AS y1, x2 * f AS x2, y2 * f AS y2 FROM f",
    "page_sizes": f"WITH {X.BODY_SQL} SELECT book_id, line_idx, CASE WHEN page_number % 4 > 0 THEN 1700.0 + page_number ELSE -1.0 END::DOUBLE AS page_w, CASE WHEN page_number % 4 > 0 THEN 2200.0 ELSE -1.0 END::DOUBLE AS page_h FROM body",
}
