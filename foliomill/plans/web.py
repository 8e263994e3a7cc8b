"""Queries over XHTML pages: a host is a book, its pages in order the spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions import entities
from foliomill.functions.text import clean_book_text, clean_epub_text
from foliomill.operators import slicing as S
from foliomill.plans import fixtures as X
from foliomill.sources import formats
from foliomill.sources import html_blocks as H

HOST = r"^https?://([^/?#]+)"


def spine(spark: SparkSession, d: str) -> DataFrame:
    """book (host), page_id, spine_idx, file (url path), html."""
    pages = X.table(spark, d, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("book_id"), F.regexp_extract("url", HOST + r"/([^?#]*)", 2).alias("file"), "url", "html")
    return pages.withColumn("spine_idx", (F.row_number().over(W.partitionBy("book_id").orderBy("page_id")) - 1).cast("int"))


SPINE_SQL = "spine AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS book_id, regexp_extract(url, '^https?://([^/?#]+)/([^?#]*)', 2) AS file, url, html, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) - 1 AS INT) AS spine_idx FROM pages)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    found = H.blocks(X.table(spark, d, "pages"), "page_id")
    keyed = found.join(spine(spark, d).select(F.col("page_id").alias("doc_key"), "book_id", "spine_idx", "file"), "doc_key")
    return S.global_order(keyed)


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return H.blocks(X.table(spark, d, "pages"), "page_id").select(F.col("doc_key").alias("page_id"), "seq", "type", "level", "tag", "text")


def html_block_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.blocks(X.table(spark, d, "pages"), "page_id").groupBy("type", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    """An entry for each page, named by its path; every fifth is of depth 1, some paths are in other case or lack folders."""
    name = F.when(F.col("page_id") % 3 == 1, F.upper("file")).when(F.col("page_id") % 3 == 2, S.base_name(F.col("file"))).otherwise(F.col("file"))
    return spine(spark, d).select("book_id", F.col("page_id").alias("toc_index"), name.alias("toc_file"), F.concat(F.lit("Page "), F.col("page_id")).alias("title"), F.when(F.col("page_id") % 5 == 0, 1).otherwise(0).alias("depth"))


_TOC_SQL = "toc AS (SELECT book_id, page_id AS toc_index, CASE page_id % 3 WHEN 1 THEN upper(file) WHEN 2 THEN string_split(file, '/')[-1] ELSE file END AS toc_file, 'Page ' || page_id AS title, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS depth FROM spine)"


def toc_file_match(spark: SparkSession, d: str) -> DataFrame:
    files = spine(spark, d).select("book_id", "spine_idx", "file")
    return S.match_files(_toc(spark, d), files).select("book_id", "toc_index", "file", F.coalesce("spine_idx", F.lit(-1)).alias("spine_idx"))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    """Cuts at the paragraphs whose index is a multiple of 7 or 5, from the lines of books."""
    lines = X.body_lines(spark, d).withColumn("block_index", (F.row_number().over(W.partitionBy("book_id").orderBy("line_idx")) - 1).cast("int"))
    cuts = lines.where("block_index % 7 = 3 OR block_index % 5 = 2")
    doubled = cuts.withColumn("depth", (F.col("block_index") % 2).cast("int")).unionByName(cuts.withColumn("depth", F.lit(0)))
    return doubled.select("book_id", "block_index", "depth", (F.col("block_index") * 2 + F.col("depth")).alias("toc_index"), F.concat(F.lit("Cut "), F.col("block_index"), F.lit("/"), F.col("depth")).alias("title"))


def cut_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return S.dedupe_cuts(_cuts(spark, d).where("depth = 1 OR block_index % 3 = 0").distinct()).select("book_id", "block_index", "depth", "title")


def toc_slices(spark: SparkSession, d: str) -> DataFrame:
    """Books of lines sliced at their cuts; those with one cut or none by headings."""
    lines = X.body_lines(spark, d).withColumn("block_index", (F.row_number().over(W.partitionBy("book_id").orderBy("line_idx")) - 1).cast("int"))
    head = F.col("text").startswith("Chapter ")
    blocks = lines.select("book_id", "block_index", "text", F.when(head, "heading").otherwise("paragraph").alias("type"), F.when(head, 1).alias("level"))
    return S.build_book(blocks, _cuts(spark, d).distinct()).select("book_id", "block_index", "chapter_order", "title", "paragraph_order")


def heading_slices(spark: SparkSession, d: str) -> DataFrame:
    """Books of web pages sliced at their headings."""
    blocks = _blocks(spark, d)
    return S.slice_by_cuts(blocks, S.heading_cuts(blocks)).groupBy("book_id", "chapter_order").agg(F.first("title").alias("title"), F.count(F.lit(1)).alias("n_blocks"))


def fragment_locate(spark: SparkSession, d: str) -> DataFrame:
    """Every entry names an anchor that the third block of each fourth page holds; others fall back to their file's start."""
    pages = spine(spark, d)
    per_page = pages.select("book_id", "spine_idx", "page_id", (F.length("url") % 4 + 3).alias("n"))
    order = W.partitionBy("book_id").orderBy("spine_idx").rowsBetween(W.unboundedPreceding, -1)
    starts = per_page.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    anchors = starts.where("page_id % 4 = 0").select("book_id", "spine_idx", F.concat(F.lit("a"), F.col("page_id") % 3).alias("fragment"), (F.col("start") + 2).alias("block_index"))
    entries = pages.select("book_id", F.col("page_id").alias("toc_index"), "file", "spine_idx", F.concat(F.lit("a"), F.col("page_id") % 3).alias("fragment"))
    return S.locate(entries, anchors, starts.select("book_id", "spine_idx", "start")).select("book_id", "toc_index", "block_index")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return spine(spark, d).where("page_id % 2 = 0").select("book_id", F.col("page_id").alias("asset_idx"), F.concat(F.col("file"), F.lit(".png")).alias("path"), F.concat(F.lit("/assets/"), F.col("page_id")).alias("url"))


def image_src_resolve(spark: SparkSession, d: str) -> DataFrame:
    src = F.when(F.col("page_id") % 3 == 0, F.concat("file", F.lit(".png"))).when(F.col("page_id") % 3 == 1, F.concat(S.base_name(F.col("file")), F.lit(".png"))).otherwise("")
    images = spine(spark, d).select("book_id", "page_id", "file", src.alias("image_src"))
    return S.resolve_images(images, _assets(spark, d)).select("book_id", "page_id", "image_src", "image_url")


def asset_safe_names(spark: SparkSession, d: str) -> DataFrame:
    assets = spine(spark, d).select("book_id", F.col("page_id").alias("asset_idx"), F.regexp_replace("url", "[0-9]+", "#").alias("path"))
    return S.safe_asset_names(assets.withColumn("path", F.concat("path", F.lit(".png")))).select("book_id", "asset_idx", "safe_name")


def clean_text_epub_core(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", clean_book_text(F.col("text")).alias("clean"))


def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    """Every page's source with its character references resolved; ids in front stand for pages with many kinds of them."""
    given = F.concat(F.lit("&#"), (F.col("page_id") * 7).cast("string"), F.lit(";&#x"), F.hex("page_id"), F.lit("&notit;&amp;lt;&NotEqualTilde;&copy2&bogus; "), F.col("html"))
    return X.table(spark, d, "pages").select("page_id", F.md5(entities.html_unescape(given)).alias("text_md5"))


def clean_text_epub(spark: SparkSession, d: str) -> DataFrame:
    """Every page's source cleaned as a text, references first."""
    return X.table(spark, d, "pages").select("page_id", clean_epub_text(F.col("html")).alias("clean"))


def format_routing(spark: SparkSession, d: str) -> DataFrame:
    """Which parser takes a file of each page's address, and the error where none does; .htm is registered beside those that are there."""
    known = formats.default_formats().register(".htm", "xhtml", formats.xhtml)
    named = X.table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ("", ".TXT", ".xhtml", ".pdf", ".tar.gz", ".htm"))), (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    routed = known.route(named)
    return routed.select("page_id", "extension", F.coalesce("parser", F.lit("")).alias("parser"), F.coalesce("error", F.lit("")).alias("error"))


QUERIES = {
    "html_unescape": html_unescape, "clean_text_epub": clean_text_epub, "format_routing": format_routing,
    "html_blocks": html_blocks, "html_block_counts": html_block_counts, "toc_file_match": toc_file_match, "cut_dedupe": cut_dedupe, "toc_slices": toc_slices, "heading_slices": heading_slices,
    "fragment_locate": fragment_locate, "image_src_resolve": image_src_resolve, "asset_safe_names": asset_safe_names, "clean_text_epub_core": clean_text_epub_core,
}



def unescape_sql(source: str) -> str:
    """Texts of `source` (id, text) without character references, as `unescaped`: references are rows, names are a table."""
    quote = lambda t: "'" + t.replace("'", "''") + "'" if t.isprintable() else " || ".join(f"chr({ord(c)})" for c in t)
    names = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in entities.html5.items())
    windows = " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in entities.WINDOWS.items())
    return rf"""names(name, value) AS (VALUES {names}),
split AS (SELECT id, string_split_regex(text, '&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)') AS parts, regexp_extract_all(text, '&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)', 1) AS refs FROM {source}),
refs AS (SELECT id, i, refs[i] AS ref FROM (SELECT id, refs, unnest(range(1, len(refs) + 1)) AS i FROM split)),
kinds AS (SELECT ref, CASE WHEN ref LIKE '#%' THEN coalesce(CASE WHEN ref[2] IN ('x', 'X') THEN TRY_CAST('0x' || regexp_replace(ref, '^#[xX]|;$', '', 'g') AS BIGINT) ELSE TRY_CAST(regexp_replace(ref, '^#|;$', '', 'g') AS BIGINT) END, 1114112) END AS code FROM (SELECT DISTINCT ref FROM refs)),
shorter AS (SELECT ref, arg_max(value, length(name)) AS value, max(length(name)) AS n FROM kinds JOIN names ON starts_with(ref, name) AND length(name) BETWEEN 2 AND length(ref) - 1 WHERE code IS NULL GROUP BY ref),
decoded AS (SELECT k.ref, CASE WHEN code IS NULL THEN coalesce(n.value, s.value || substr(k.ref, s.n + 1), '&' || k.ref)
    WHEN code = 13 THEN chr(13) WHEN code BETWEEN 128 AND 159 THEN CASE code {windows} END WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533)
    WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 OR code BETWEEN 64976 AND 65007 OR code & 65534 = 65534 THEN '' ELSE chr(CAST(code AS INT)) END AS value
  FROM kinds k LEFT JOIN names n ON n.name = k.ref LEFT JOIN shorter s ON s.ref = k.ref),
values_ AS (SELECT id, list(value ORDER BY i) AS vs FROM refs JOIN decoded USING (ref) GROUP BY id),
unescaped AS (SELECT s.id, CASE WHEN vs IS NULL THEN parts[1] ELSE array_to_string(list_transform(parts, lambda p, i: p || coalesce(vs[i], '')), '') END AS text FROM split s LEFT JOIN values_ v ON v.id = s.id)"""


_CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(173), ''), '[‐‑]', '-', 'g'), '[\s\x0B\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '([a-z])-\s+([a-z])', '\1\2', 'g'), '\s+([,.:;!?)\]}>%])', '\1', 'g'), '^\s+|\s+$', '', 'g')"

_NUMBERED = X.BODY_SQL + """, numbered AS (SELECT book_id, text, CAST(row_number() OVER (PARTITION BY book_id ORDER BY line_idx) - 1 AS INT) AS block_index FROM body),
raw_cuts AS (SELECT book_id, block_index, block_index % 2 AS depth FROM numbered WHERE block_index % 7 = 3 OR block_index % 5 = 2 UNION SELECT book_id, block_index, 0 FROM numbered WHERE block_index % 7 = 3 OR block_index % 5 = 2)"""

ORACLES = {
    "toc_file_match": f"""WITH {SPINE_SQL}, {_TOC_SQL},
m AS (SELECT t.book_id, toc_index, s.file, s.spine_idx, CASE WHEN t.toc_file = s.file OR string_split(t.toc_file, '/')[-1] = string_split(s.file, '/')[-1] OR ends_with(t.toc_file, s.file) OR ends_with(s.file, t.toc_file) THEN 0
    WHEN lower(string_split(t.toc_file, '/')[-1]) = lower(string_split(s.file, '/')[-1]) THEN 1 END AS tier FROM toc t JOIN spine s ON t.book_id = s.book_id WHERE toc_file <> ''),
b AS (SELECT book_id, toc_index, arg_min(file, (tier, spine_idx)) AS file, arg_min(spine_idx, (tier, spine_idx)) AS spine_idx FROM m WHERE tier IS NOT NULL GROUP BY ALL)
SELECT book_id, toc_index, file, coalesce(spine_idx, -1) AS spine_idx FROM toc LEFT JOIN b USING (book_id, toc_index)""",
    "cut_dedupe": f"""WITH {_NUMBERED}, c AS (SELECT * FROM raw_cuts WHERE depth = 1 OR block_index % 3 = 0)
SELECT book_id, block_index, CAST(min(depth) AS INT) AS depth, 'Cut ' || block_index || '/' || min(depth) AS title FROM c GROUP BY book_id, block_index""",
    "toc_slices": f"""WITH {_NUMBERED},
top AS (SELECT DISTINCT book_id, block_index, 'Cut ' || block_index || '/0' AS title FROM raw_cuts WHERE depth = 0),
enough AS (SELECT book_id FROM top GROUP BY book_id HAVING count(*) >= 2),
cuts AS (SELECT * FROM top WHERE book_id IN (SELECT book_id FROM enough) UNION ALL SELECT book_id, block_index, text FROM numbered WHERE starts_with(text, 'Chapter ') AND book_id NOT IN (SELECT book_id FROM enough)),
j AS (SELECT n.book_id, n.block_index, c.title AS cut, count(c.title) OVER (PARTITION BY n.book_id ORDER BY n.block_index) AS nth, count(c.title) OVER (PARTITION BY n.book_id) AS k,
    max(CASE WHEN n.block_index = 0 AND c.title IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY n.book_id) AS front FROM numbered n LEFT JOIN cuts c ON n.book_id = c.book_id AND n.block_index = c.block_index),
o AS (SELECT *, CAST(CASE WHEN nth = 0 THEN 0 ELSE nth - 1 + front END AS INT) AS chapter_order, CASE WHEN k = 0 THEN '全书' WHEN nth = 0 THEN 'Front Matter' ELSE max(cut) OVER (PARTITION BY book_id, nth) END AS title FROM j)
SELECT book_id, block_index, chapter_order, title, CAST(row_number() OVER (PARTITION BY book_id, chapter_order ORDER BY block_index) - 1 AS INT) AS paragraph_order FROM o""",
    "fragment_locate": f"""WITH {SPINE_SQL},
s AS (SELECT book_id, spine_idx, page_id, CAST(coalesce(sum(length(url) % 4 + 3) OVER (PARTITION BY book_id ORDER BY spine_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM spine),
a AS (SELECT book_id, spine_idx, 'a' || page_id % 3 AS fragment, start + 2 AS block_index FROM s WHERE page_id % 4 = 0),
g AS (SELECT book_id, fragment, arg_max(block_index, spine_idx) AS any_index FROM a GROUP BY ALL)
SELECT s.book_id, s.page_id AS toc_index, CAST(coalesce(a.block_index, any_index, start) AS INT) AS block_index FROM s
LEFT JOIN a ON a.book_id = s.book_id AND a.spine_idx = s.spine_idx AND a.fragment = 'a' || s.page_id % 3 LEFT JOIN g ON g.book_id = s.book_id AND g.fragment = 'a' || s.page_id % 3""",
    "image_src_resolve": f"""WITH {SPINE_SQL},
assets AS (SELECT book_id, page_id AS idx, file || '.png' AS path, '/assets/' || page_id AS url FROM spine WHERE page_id % 2 = 0),
i AS (SELECT book_id, page_id, file, CASE page_id % 3 WHEN 0 THEN file || '.png' WHEN 1 THEN string_split(file, '/')[-1] || '.png' ELSE '' END AS src FROM spine),
r AS (SELECT *, CASE WHEN regexp_extract(file, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' || src ELSE src END AS rel FROM i)
SELECT r.book_id, page_id, src AS image_src, CASE WHEN src = '' THEN '' ELSE coalesce(
  (SELECT arg_min(url, idx) FROM assets a WHERE a.book_id = r.book_id AND a.path = src), (SELECT arg_min(url, idx) FROM assets a WHERE a.book_id = r.book_id AND a.path = rel),
  (SELECT arg_min(url, idx) FROM assets a WHERE a.book_id = r.book_id AND string_split(a.path, '/')[-1] = string_split(src, '/')[-1]), src) END AS image_url FROM r""",
    "asset_safe_names": f"""WITH {SPINE_SQL},
n AS (SELECT book_id, page_id, regexp_replace(string_split(regexp_replace(url, '[0-9]+', '#', 'g') || '.png', '/')[-1], '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM spine),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY page_id) - 1 AS nth FROM n)
SELECT book_id, page_id AS asset_idx, CASE WHEN nth = 0 THEN name ELSE regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || nth || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) END AS safe_name FROM k""",
    "clean_text_epub_core": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(173), ''), '[‐‑]', '-', 'g'), '\s+', ' ', 'g'), '([a-z])-\s+([a-z])', '\1\2', 'g'), '\s+([,.:;!?)\]}>%])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""",
    "html_unescape": f"""WITH pages_ AS (SELECT page_id AS id, '&#' || page_id * 7 || ';&#x' || printf('%X', page_id) || '&notit;&amp;lt;&NotEqualTilde;&copy2&bogus; ' || html AS text FROM pages), {unescape_sql('pages_')}
SELECT id AS page_id, md5(text) AS text_md5 FROM unescaped""",
    "clean_text_epub": f"WITH pages_ AS (SELECT page_id AS id, html AS text FROM pages), {unescape_sql('pages_')} SELECT id AS page_id, {_CLEAN_SQL} AS clean FROM unescaped",
    "format_routing": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['', '.TXT', '.xhtml', '.pdf', '.tar.gz', '.htm'][page_id % 6 + 1] AS path FROM pages),
e AS (SELECT page_id, lower(regexp_extract(string_split(path, '/')[-1], '\.[^.]+$')) AS extension FROM p)
SELECT page_id, extension, CASE extension WHEN '.txt' THEN 'text' WHEN '.html' THEN 'xhtml' WHEN '.htm' THEN 'xhtml' WHEN '.xhtml' THEN 'xhtml' ELSE '' END AS parser,
  CASE WHEN extension IN ('.txt', '.html', '.htm', '.xhtml') THEN '' ELSE 'unsupported format: ' || extension END AS error FROM e""",
}
