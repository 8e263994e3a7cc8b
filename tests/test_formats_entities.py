"""Character references against Python's own decoder; formats by extension; settings and times."""

from __future__ import annotations

import html
import random
from datetime import datetime

from pyspark.sql import functions as F

from foliomill.functions.entities import html_unescape
from foliomill.functions.text import clean_epub_text
from foliomill.sources import formats as S

BITS = [
    "&amp;", "&amp;lt;", "&lt", "&ltx;", "&notit;", "&not", "&NotEqualTilde;", "&#65;", "&#65", "&#x41;", "&#X1F600;", "&#128;", "&#x80", "&#0;", "&#xD800;", "&#99999999999;", "&#1;", "&#13;", "&#x85;", "&#129;",
    "&#xFFFE;", "&#11;", "&", "& ", "&&", "&x", "&copy2", "&nbsp;", "&Aacute;", "&bogus;", "a b", "é", "&#;", "&#x;", "&#00000065;", "&#127;", "&#64976;", "&#x10FFFF;", "&ampamp;", "&frac12x", "&CounterClockwiseContourIntegral;", "&" + "y" * 40,
]


def test_references_as_python_decodes_them(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 7))) for _ in range(1500)] + [html.escape("&" * 2000)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", html_unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == (html.unescape(r.t) if r.t is not None else None) for r in got)


def test_clean_epub_text(spark):
    row = spark.createDataFrame([("A&nbsp;&nbsp;well-&shy;known exam- ple &lt;b&gt; , done&#8209;so .  ",)], "t string").select(clean_epub_text(F.col("t")).alias("c")).first()
    assert row.c == "A well-known example <b>, done-so."


def test_formats_are_read_where_they_lie(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.TXT": "one\ntwo\r\n\r\n three\n \n\n", "sub/b.html": "<p>x &amp; y</p><h2>t</h2>", "c.pdf": "%PDF", "none": "?", "d.md": "# head", "e.txt": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    known = S.default_formats()
    rows = lambda f: sorted((r.path.rsplit("/", 1)[1], r.seq, r.type, r.text, r.error) for r in f.read(spark, str(tmp_path)).collect())
    want = [("a.TXT", 0, "paragraph", "one two", None), ("a.TXT", 1, "paragraph", "three", None), ("b.html", 0, "paragraph", "x & y", None), ("b.html", 1, "heading", "t", None)]
    bad = [("c.pdf", 0, "error", "", "unsupported format: .pdf"), ("d.md", 0, "error", "", "unsupported format: .md"), ("none", 0, "error", "", "unsupported format: ")]
    assert rows(known) == sorted(want + bad)
    known.register(".MD", "markdown", S.plain_text)
    assert ("d.md", 0, "paragraph", "# head", None) in rows(known)


def test_settings_and_times(spark, tmp_path):
    (tmp_path / "app.conf").write_text("batch = 8\nmodel=small\n# note\n")
    (tmp_path / "translate.txt").write_text("Translate.\nKeep names.")
    spark.conf.set("spark.foliomill.model", "large")
    got = {r.name: r.value for r in S.settings(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.foliomill.model")
    assert got == {"batch": "8", "model": "large", "translate": "Translate.\nKeep names."}
    now = S.stamped(spark.range(3), now=F.lit(datetime(2024, 1, 2, 3, 4, 5)))
    assert {r.updated_at for r in now.collect()} == {"2024-01-02 03:04:05"}
    assert S.stamped(spark.range(3)).select("updated_at").distinct().count() == 1
