from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from foliomill.operators import pipelines as J
from foliomill.plans import fixtures as X
from foliomill.sources import epub
from foliomill.sources.pages import to_page_rows

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf"><manifest>
<item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/>
<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="i" href="img/p 1.png" media-type="image/png"/></manifest>
<spine><itemref idref="a"/><itemref idref="zz"/><itemref idref="c" linear="no"/><itemref idref="b"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> One </text></navLabel><content src="text/a.xhtml#one"/>
<navPoint><navLabel><text>Sub</text></navLabel><content src="text/b.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="text/b.xhtml#two"/></navPoint></navMap></ncx>"""
A = '<html><body><p>before</p><h1 id="one">One</h1><p>a &amp; b<img src="../img/p 1.png" alt="pic"/></p></body></html>'
B = '<html><body><p>still one</p><p><a id="two"></a>second</p></body></html>'


def archive(files: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_epub(spark):
    whole = archive({"META-INF/container.xml": CONTAINER, "OPS/book.opf": PACKAGE, "OPS/toc.ncx": NCX, "OPS/text/a.xhtml": A, "OPS/text/b.xhtml": B, "OPS/c.xhtml": "<p>no</p>", "OPS/img/p 1.png": "png"})
    rows = epub.scan(spark.createDataFrame([("/x/good.epub", whole), ("/x/bad.epub", bytearray(b"junk"))], "path string, content binary")).cache()
    assert [r.name for r in rows.where("kind = 'spine'").orderBy("idx").collect()] == ["OPS/text/a.xhtml", "OPS/text/b.xhtml"]
    assert [(r.title, r.name, r.depth) for r in rows.where("kind = 'toc'").orderBy("idx").collect()] == [("One", "OPS/text/a.xhtml", 0), ("Sub", "OPS/text/b.xhtml", 1), ("Two", "OPS/text/b.xhtml", 0)]
    assert rows.where("kind = 'error'").count() == 1
    assert [r.safe_name for r in epub.assets(rows).collect()] == ["p_1.png"]
    got = epub.books(rows).orderBy("block_index").collect()
    assert [(r.text, r.title, r.chapter_order) for r in got] == [("before", "Front Matter", 0), ("One", "One", 1), ("a & b", "One", 1), ("pic", "One", 1), ("still one", "One", 1), ("second", "Two", 2)]
    assert [r.image_url for r in got if r.type == "image"][0].endswith("/p_1.png")


def test_parse_translate_migrate(spark, sf_dir):
    pages = to_page_rows(X.page_lines(spark, sf_dir).where("book_id < 12"))
    pages = pages.unionByName(pages.limit(1).withColumns({"book_id": F.lit(999).cast("long"), "lines_json": F.lit("not json")}))
    parsed = J.parse_books(pages)
    states = {r.book_id: r.parse_status for r in parsed["books"].collect()}
    assert states[999] == "failed" and set(states.values()) == {"completed", "failed"}
    paras = parsed["paragraphs"].select(
        F.col("book_id").alias("chapter_id"), F.concat_ws("-", F.col("book_id").cast("string"), F.col("para_idx").cast("string")).alias("paragraph_id"), F.col("para_idx").alias("paragraph_order"), "text", F.lit("pending").alias("status"), F.lit("").alias("translation"), F.lit("").alias("error_message")
    )

    def provider():
        from foliomill.plans.enrichment import EchoProvider

        return EchoProvider()

    cache = spark.createDataFrame([], "source_hash string, translated_text string, status string")
    done = J.translate_chapters(paras, cache, provider)
    counts = {r.status: r["count"] for r in done["paragraphs"].groupBy("status").count().collect()}
    assert counts["completed"] > 0 and "pending" not in counts
    assert done["cache"].count() == done["results"].where("status = 'completed'").select("source_hash").distinct().count()
    assert {r.translate_status for r in done["chapters"].collect()} <= {"completed", "partial"}
    old = parsed["paragraphs"].select("book_id", F.col("para_idx").alias("old_id"), F.col("para_idx").alias("old_order"), "page_number", F.col("text").alias("old_text"), F.lit("zh").alias("translation"))
    moved = J.migrate_books(pages, old).collect()
    assert moved and all(r.status == "completed" and r.similarity == 1.0 for r in moved)
    assert J.chapter_translations(done["paragraphs"]).where("total >= completed").count() == paras.count()
