"""Book views over the driver tables: one document is one book, its lines laid out on pages.

The same rules as SQL, for the oracles, stand beside each view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import PREFIXES, SUFFIXES

PAGE_W, PAGE_H, PAGE_LINES = 1700.0, 2200.0, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body_lines(spark: SparkSession, sf_dir: str, page_lines: int = PAGE_LINES, dealt: bool = False) -> DataFrame:
    """Lines of the text, without page headers and footers. If `dealt`, whole texts are dealt by book first, and what follows by book exchanges nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if dealt:
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    docs = docs.select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    k, t = F.col("k"), F.trim("raw")
    lowered = F.concat(F.lower(F.substring(F.col("t0"), 1, 1)), F.expr("substring(t0, 2)"))
    bare = F.rtrim("t0", F.lit(".!?"))
    cut = F.concat(F.lower(F.substring(bare, 1, 1)), F.expr("substring(rtrim('.!?', t0), 2)"))
    text = (
        F.when(k % 9 == 0, F.concat(F.lit("Chapter "), F.floor(k / 9 + 1).cast("string")))
        .when((k % 6 == 4) | (k % 10 == 7), F.concat(cut, F.when(k % 10 == 7, "-").otherwise("")))
        .when((k % 6 == 5) | (k % 10 == 8), lowered)
        .otherwise(F.col("t0"))
    )
    lines = docs.withColumn("t0", t).where("t0 <> ''").withColumn("text", text)
    x1 = F.when(k % 5 == 3, 240.0).otherwise(200.0)
    y1 = 400.0 + 40.0 * (k % page_lines) + F.when(k % 7 == 6, 60.0).otherwise(0.0)
    return lines.select(
        "book_id",
        (F.floor(k / page_lines) + 1).cast("int").alias("page_number"),
        (F.floor(k / page_lines) * 10 + k % page_lines + 1).cast("long").alias("line_idx"),
        "text",
        x1.alias("x1"),
        y1.alias("y1"),
        F.least(x1 + 8.0 * F.length("text"), F.lit(1500.0)).alias("x2"),
        (y1 + F.when(k % 9 == 0, 36.0).otherwise(24.0)).alias("y2"),
        (0.5 + (F.length("text") % 8) / 16.0).cast("double").alias("confidence"),
        F.lit(PAGE_W).alias("page_w"),
        F.lit(PAGE_H).alias("page_h"),
    )


BODY_SQL = """body AS (
  SELECT book_id, CAST(k // 4 + 1 AS INT) AS page_number, CAST((k // 4) * 10 + k % 4 + 1 AS BIGINT) AS line_idx, text, x1, y1,
    least(x1 + 8.0 * length(text), 1500.0)::DOUBLE AS x2, y1 + CASE WHEN k % 9 = 0 THEN 36.0 ELSE 24.0 END::DOUBLE AS y2,
    (0.5 + (length(text) % 8) / 16.0)::DOUBLE AS confidence, 1700.0::DOUBLE AS page_w, 2200.0::DOUBLE AS page_h
  FROM (SELECT book_id, k,
      CASE WHEN k % 5 = 3 THEN 240.0 ELSE 200.0 END::DOUBLE AS x1,
      (400.0 + 40.0 * (k % 4) + CASE WHEN k % 7 = 6 THEN 60.0 ELSE 0.0 END)::DOUBLE AS y1,
      CASE WHEN k % 9 = 0 THEN 'Chapter ' || CAST(k // 9 + 1 AS VARCHAR)
           WHEN k % 6 = 4 OR k % 10 = 7 THEN lower(substr(bare, 1, 1)) || substr(bare, 2) || CASE WHEN k % 10 = 7 THEN '-' ELSE '' END
           WHEN k % 6 = 5 OR k % 10 = 8 THEN lower(substr(t0, 1, 1)) || substr(t0, 2) ELSE t0 END AS text
    FROM (SELECT *, regexp_replace(t0, '[.!?]+$', '') AS bare FROM (
      SELECT doc_id AS book_id, unnest(range(len(ls))) AS k, trim(unnest(ls)) AS t0
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE t0 <> '')))"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines: the body, a running header with the source, and the page number at the foot."""
    body = body_lines(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "source")
    pages = body.select("book_id", "page_number").distinct().join(sources, "book_id")

    def edge(text, slot: int, y1: float) -> DataFrame:
        return pages.select(
            "book_id", "page_number", ((F.col("page_number") - 1) * 10 + slot).cast("long").alias("line_idx"), text.alias("text"), F.lit(200.0).alias("x1"), F.lit(y1).alias("y1"),
            (200.0 + 8.0 * F.length(text)).alias("x2"), F.lit(y1 + 24).alias("y2"), (0.5 + (F.length(text) % 8) / 16.0).cast("double").alias("confidence"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"),
        )

    return body.unionByName(edge(F.col("source"), 0, 44.0)).unionByName(edge(F.col("page_number").cast("string"), 9, 2112.0))


LINES_SQL = (
    BODY_SQL
    + """,
edges AS (SELECT DISTINCT b.book_id, page_number, source FROM body b JOIN documents d ON b.book_id = d.doc_id),
lines AS (
  SELECT * FROM body
  UNION ALL SELECT book_id, page_number, CAST((page_number - 1) * 10 AS BIGINT), source, 200.0, 44.0, (200.0 + 8.0 * length(source))::DOUBLE, 68.0, (0.5 + (length(source) % 8) / 16.0)::DOUBLE, 1700.0, 2200.0 FROM edges
  UNION ALL SELECT book_id, page_number, CAST((page_number - 1) * 10 + 9 AS BIGINT), CAST(page_number AS VARCHAR), 200.0, 2112.0, (200.0 + 8.0 * length(CAST(page_number AS VARCHAR)))::DOUBLE, 2136.0, (0.5 + (length(CAST(page_number AS VARCHAR)) % 8) / 16.0)::DOUBLE, 1700.0, 2200.0 FROM edges)"""
)

CLEAN_SQL = (
    LINES_SQL
    + """,
rel AS (SELECT *, round((y1 + y2) / 2 / page_h, 1) AS rel, lower(trim(text)) AS norm, count(*) OVER (PARTITION BY book_id) AS n_lines FROM lines),
page_counts AS (SELECT book_id, count(DISTINCT page_number) AS n_pages FROM lines GROUP BY book_id),
recurring AS (SELECT book_id, rel, norm FROM rel JOIN page_counts USING (book_id) WHERE (rel <= 0.15 OR rel >= 0.88) AND norm <> ''
  GROUP BY book_id, rel, norm, n_pages
  HAVING count(DISTINCT page_number) >= CASE WHEN n_pages <= 5 THEN greatest(2, floor(n_pages * 0.45)) ELSE 3 END AND count(DISTINCT page_number) / n_pages >= 0.40),
clean AS (SELECT r.* EXCLUDE (rel, norm, n_lines) FROM rel r JOIN page_counts p USING (book_id) LEFT JOIN recurring g ON r.book_id = g.book_id AND r.rel = g.rel AND r.norm = g.norm
  WHERE NOT (n_lines >= 5 AND n_pages >= 3 AND (g.book_id IS NOT NULL OR (regexp_matches(r.norm, '^[0-9]{1,5}$') AND (r.rel < 0.10 OR r.rel > 0.88)))))"""
)



def hyphen_sql(source: str) -> str:
    """Lines joined over hyphens, as `unhyphened`: one line of every book at a time takes or joins the head before it."""
    prefixes, suffixes = (", ".join(f"'{w}'" for w in words) for words in (PREFIXES, SUFFIXES))
    return rf"""numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY line_idx) AS r FROM {source}),
joined_lines AS (
  SELECT book_id, r, r AS head, page_number, line_idx, text, x1, y1, x2, y2, confidence, page_w, page_h FROM numbered WHERE r = 1
  UNION ALL
  SELECT book_id, r, CASE WHEN fits THEN head ELSE r END, CASE WHEN fits THEN page_number ELSE page_number2 END, CASE WHEN fits THEN line_idx ELSE line_idx2 END, CASE WHEN fits THEN first || second ELSE text2 END,
    CASE WHEN fits THEN x1 ELSE x12 END, CASE WHEN fits THEN y1 ELSE y12 END, CASE WHEN fits THEN greatest(x2, x22) ELSE x22 END, CASE WHEN fits THEN greatest(y2, y22) ELSE y22 END,
    CASE WHEN fits THEN CAST(format('{{:.4f}}', (confidence * length(first) + confidence2 * length(second)) / (length(first) + length(second))) AS DOUBLE) ELSE confidence2 END, page_w, page_h
  FROM (SELECT *, ends AND regexp_matches(second, '^\p{{Ll}}') AND page_number2 - page_number IN (0, 1) AND length(first) > 2 AND length(second) > 2
      AND (lower(second) IN ({suffixes}) OR lower(first) IN ({prefixes}) OR (NOT regexp_matches(first, '^\p{{Lu}}') AND length(first) + length(second) >= 6)) AS fits
    FROM (SELECT h.* EXCLUDE (r), n.r, n.page_number AS page_number2, n.line_idx AS line_idx2, n.text AS text2, n.x1 AS x12, n.y1 AS y12, n.x2 AS x22, n.y2 AS y22, n.confidence AS confidence2,
        regexp_matches(h.text, '-\s*$') AS ends, regexp_replace(regexp_replace(h.text, '-\s*$', ''), '^\s+|\s+$', '', 'g') AS first, regexp_replace(n.text, '^\s+', '') AS second
      FROM joined_lines h JOIN numbered n ON n.book_id = h.book_id AND n.r = h.r + 1))),
unhyphened AS (SELECT book_id, page_number, line_idx, text, x1, y1, x2, y2, confidence, page_w, page_h FROM (SELECT *, row_number() OVER (PARTITION BY book_id, head ORDER BY r DESC) AS nth FROM joined_lines) WHERE nth = 1)"""


_CLEAN_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace({}, ' {{2,}}', ' ', 'g'), '\s+([,.:;!?)\]}}>%])', '\1', 'g'), '([\[({{¿¡])\s+', '\1', 'g'))"
_HEADING = r"""(regexp_matches({0}, '(?i)^(chapter|ch\.?)\s+\d+[\.:]?\s*$') OR regexp_matches({0}, '(?i)^(chapter|ch\.?)\s+(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)\b')
  OR regexp_matches({0}, '(?i)^(part|pt\.?)\s+\d+[\.:]?\s*$') OR regexp_matches({0}, '(?i)^(introduction|preface|prologue|epilogue|appendix|index|bibliography|foreword|acknowledgements?|about the author|afterword|conclusion|summary|notes|references?)\b')
  OR regexp_matches({0}, '^[IVXLCDM]{{2,}}\.'))"""

#: Breaks, paragraphs, merges and chapters over the body lines.
BREAKS_SQL = """,
gaps AS (SELECT *, median(x1) OVER (PARTITION BY book_id, page_number) AS left_x, lag(y2 - y1) OVER w AS ph, y2 - y1 AS ch, y1 - lag(y2) OVER w AS gap,
    abs(x1 - lag(x1) OVER w) AS dx, lag(x2 - x1) OVER w AS pw, trim(lag(text) OVER w) AS pt,
    abs((x1 + x2) / 2 - page_w / 2) < page_w * 0.08 AND x1 > page_w * 0.15 AND x2 - x1 < page_w * 0.55 AS centred,
    row_number() OVER w AS nth
  FROM {source} WINDOW w AS (PARTITION BY book_id ORDER BY line_idx)),
marked AS (SELECT *, CAST(sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY line_idx) AS INT) AS para_idx FROM (
  SELECT *, nth > 1 AND (trim(text) = '' OR (ph > 0 AND gap > ph * 1.5) OR x1 - left_x > 15 OR dx > greatest(ph, ch) * 2
    OR (pw < page_w * 0.55 AND regexp_matches(pt, '[.!?]$')) OR greatest(ph, ch) / least(ph, ch) > 1.30 OR centred) AS is_break FROM gaps)),
paras AS (SELECT book_id, para_idx, """ + _CLEAN_TEXT.format("string_agg(trim(text), ' ' ORDER BY line_idx)") + """ AS text, min(page_number) AS page_number, max(page_number) AS page_end,
    CASE WHEN sum(length(text)) > 0 THEN CAST(format('{:.4f}', sum(confidence * length(text)) / sum(length(text))) AS DOUBLE) ELSE 0.0 END AS confidence, first(centred ORDER BY line_idx) AS is_centred, CAST(count(*) AS INT) AS n_lines
  FROM marked GROUP BY book_id, para_idx)"""

MERGES_SQL = """,
flags AS (SELECT *, coalesce((page_number = lag(page_end) OVER w OR page_number = lag(page_end) OVER w + 1) AND lag(text) OVER w <> '' AND NOT regexp_matches(lag(text) OVER w, '[.!?]$')
    AND regexp_matches(text, '^\\p{Ll}') AND NOT is_centred, FALSE) AS joins FROM paras WINDOW w AS (PARTITION BY book_id ORDER BY para_idx)),
merge_ids AS (SELECT *, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY para_idx) - 1 AS INT) AS merge_idx FROM flags),
merged AS (SELECT book_id, merge_idx AS para_idx, string_agg(text, ' ' ORDER BY para_idx) AS text, first(page_number ORDER BY para_idx) AS page_number, last(page_end ORDER BY para_idx) AS page_end,
    first(is_centred ORDER BY para_idx) AS is_centred, CAST(count(*) AS INT) AS n_merged,
    list_reduce(list({'n': CAST(length(text) AS BIGINT), 'c': confidence} ORDER BY para_idx), lambda a, b: {'n': a.n + 1 + b.n, 'c': CASE WHEN a.n + b.n > 0 THEN CAST(format('{:.4f}', (a.c * a.n + b.c * b.n) / (a.n + b.n)) AS DOUBLE) ELSE a.c END}).c AS confidence FROM merge_ids GROUP BY book_id, merge_idx)"""

CHAPTERS_SQL = """,
heads AS (SELECT *, trim(text) <> '' AND """ + _HEADING.format("trim(text)") + """ AS is_head FROM {source}),
counted AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY para_idx) AS nth, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) AS n_heads FROM heads),
fronted AS (SELECT *, CASE WHEN n_heads > 0 THEN max(CASE WHEN nth = 0 AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) ELSE 0 END AS front FROM counted),
assigned AS (SELECT *, CAST(CASE WHEN n_heads = 0 OR nth = 0 THEN 0 ELSE nth - 1 + front END AS INT) AS chapter_order,
    CASE WHEN n_heads = 0 THEN '全文' WHEN nth = 0 THEN 'Front Matter' ELSE max(CASE WHEN is_head THEN trim(text) END) OVER (PARTITION BY book_id, nth) END AS title FROM fronted),
chapters AS (SELECT book_id, chapter_order, first(title) AS title, CAST(sum(CASE WHEN NOT is_head AND trim(text) <> '' THEN 1 ELSE 0 END) AS INT) AS paragraph_count
  FROM assigned GROUP BY book_id, chapter_order HAVING bool_or(is_head) OR sum(CASE WHEN NOT is_head AND trim(text) <> '' THEN 1 ELSE 0 END) > 0),
content AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id, chapter_order ORDER BY para_idx) - 1 AS INT) AS paragraph_order FROM assigned WHERE NOT is_head AND trim(text) <> '')"""

STRUCTURE_SQL = BODY_SQL + BREAKS_SQL.replace("{source}", "body") + MERGES_SQL + CHAPTERS_SQL.replace("{source}", "merged")
