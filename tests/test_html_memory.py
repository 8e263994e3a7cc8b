"""Memory of a task that takes XHTML apart."""

from __future__ import annotations

import gc

from foliomill.sources import html_blocks as H


def test_trees_are_freed_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        H.blocks_of("<body>" + "<div><p>x <b>y</b></p></div>" * 50 + "</body>")
        assert sum(isinstance(o, H.Node) for o in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_blocks_leave_in_pieces(spark, monkeypatch):
    """Chunks smaller than a page, and pages without text or blocks, give the same rows."""
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>"), (2, None), (3, ""), (4, "<h2 id='q'>c</h2><p><a id='z'></a>d</p>")], "page_id long, html string").coalesce(1)
    whole = sorted(map(str, H.extract(pages, "page_id").collect()))
    monkeypatch.setattr(H, "CHUNK", 1)
    assert sorted(map(str, H.extract(pages, "page_id").collect())) == whole and len(whole) == 5
