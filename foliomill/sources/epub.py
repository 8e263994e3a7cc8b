"""EPUB archives as rows: spine documents, table of contents and images.

Archives come as `binaryFile` rows; one archive is opened at a time inside mapInPandas, which yields plain rows. Blocks, cuts
and chapters are DataFrame work on those (`html_blocks`, `operators.slicing`).
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urldefrag
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.operators import slicing
from foliomill.sources import html_blocks

_SCHEMA = "book_id string, kind string, idx int, name string, title string, href string, depth int, body string, content binary, error string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _named(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [n for n in node.iter() if _local(n) == name]


def _ncx(node: ElementTree.Element, depth: int) -> Iterator[tuple[str, str, int]]:
    for point in (c for c in node if _local(c) == "navPoint"):
        label = "".join(t for n in point if _local(n) == "navLabel" for t in n.itertext()).strip()
        href = next((c.get("src", "") for c in point if _local(c) == "content"), "")
        yield label, href, depth
        yield from _ncx(point, depth + 1)


def _nav(node: ElementTree.Element, depth: int) -> Iterator[tuple[str, str, int]]:
    for item in (c for c in node if _local(c) == "li"):
        link = next((c for c in item if _local(c) in ("a", "span")), None)
        if link is not None and link.get("href") is not None:
            yield "".join(link.itertext()).strip(), link.get("href", ""), depth
        for child in (c for c in item if _local(c) == "ol"):
            yield from _nav(child, depth + 1)


def read_archive(data: bytes) -> Iterator[tuple]:
    """Rows (kind, idx, name, title, href, depth, body, content) of one archive; names are paths from its root."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        opf = _named(container, "rootfile")[0].get("full-path", "")
        package = ElementTree.fromstring(archive.read(opf))
        base = posixpath.dirname(opf)
        at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
        items = {i.get("id"): i for i in _named(package, "item")}
        documents = [i for i in items.values() if i.get("media-type") in ("application/xhtml+xml", "text/html") and "nav" not in (i.get("properties") or "").split()]
        refs = [(items.get(r.get("idref")), r.get("linear", "yes")) for r in _named(package, "itemref")]
        spine = [i for i, linear in refs if i is not None and i.get("media-type") in ("application/xhtml+xml", "text/html") and linear != "no"]
        held = set(archive.namelist())
        for k, item in enumerate(i for i in (spine or documents) if at(i.get("href", "")) in held):
            name = at(item.get("href", ""))
            yield "spine", k, name, None, None, None, archive.read(name).decode("utf-8", "replace"), None
        ncx = next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((i for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
        entries: list[tuple[str, str, int]] = []
        folder = ""
        if ncx is not None and at(ncx.get("href", "")) in held:
            tree = ElementTree.fromstring(archive.read(at(ncx.get("href", ""))))
            entries = [e for m in _named(tree, "navMap") for e in _ncx(m, 0)]
            folder = posixpath.dirname(at(ncx.get("href", "")))
        if not entries and nav is not None and at(nav.get("href", "")) in held:
            tree = ElementTree.fromstring(archive.read(at(nav.get("href", ""))))
            lists = [c for n in _named(tree, "nav")[:1] for c in n if _local(c) == "ol"]
            entries = [e for o in lists for e in _nav(o, 0)]
            folder = posixpath.dirname(at(nav.get("href", "")))
        for k, (title, href, depth) in enumerate(entries):
            file = urldefrag(href)[0]
            yield "toc", k, posixpath.normpath(posixpath.join(folder, unquote(file))) if file else "", title, href, depth, None, None
        images = [i for i in items.values() if (i.get("media-type") or "").startswith("image/")]
        for k, item in enumerate(i for i in images if at(i.get("href", "")) in held):
            name = at(item.get("href", ""))
            yield "image", k, name, None, None, None, None, archive.read(name)


def scan(files: DataFrame) -> DataFrame:
    """Rows of all archives (path, content). An archive that cannot be read is one row of kind `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, data in zip(batch["book_id"], batch["content"], strict=True):
                try:
                    rows = [(book, *row, None) for row in read_archive(bytes(data))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError) as e:
                    rows = [(book, "error", 0, None, None, None, None, None, None, str(e)[:500])]
                out = pd.DataFrame(rows, columns=_COLUMNS)
                out["depth"] = out["depth"].astype("Int32")
                yield out

    return files.select(F.md5("path").alias("book_id"), "content").mapInPandas(run, _SCHEMA)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder).select("path", "content")


def assets(rows: DataFrame, prefix: str = "/assets") -> DataFrame:
    """Images with their safe names and addresses: book_id, asset_idx, path, safe_name, url, content."""
    named = slicing.safe_asset_names(rows.where("kind = 'image'").select("book_id", F.col("idx").alias("asset_idx"), F.col("name").alias("path"), "content"))
    return named.withColumn("url", F.concat(F.lit(prefix), F.lit("/"), "book_id", F.lit("/"), "safe_name"))


def books(rows: DataFrame) -> DataFrame:
    """Paragraphs of all books, sliced into chapters: by the table of contents where it gives two cuts, else by headings."""
    spine = rows.where("kind = 'spine'").select("book_id", F.col("idx").alias("spine_idx"), F.col("name").alias("file"), "body", F.xxhash64("book_id", "idx").alias("doc_key"))
    keys = spine.select("doc_key", "book_id", "spine_idx", "file")
    found = html_blocks.blocks(spine, "doc_key", "body").join(keys, "doc_key")
    blocks = slicing.global_order(found)
    urls = slicing.resolve_images(blocks.where("type = 'image'").select("book_id", "block_index", "file", "image_src"), assets(rows)).select("book_id", "block_index", "image_url")
    blocks = blocks.join(urls, ["book_id", "block_index"], "left")
    starts = blocks.groupBy("book_id", "spine_idx").agg(F.min("block_index").alias("start"))
    anchors = _anchors(html_blocks.extract(spine, "doc_key", "body"), blocks, keys)
    toc = rows.where("kind = 'toc'").select("book_id", F.col("idx").alias("toc_index"), "title", F.col("name").alias("toc_file"), F.coalesce(F.get(F.split("href", "#"), F.lit(1)), F.lit("")).alias("fragment"), "depth")
    located = slicing.locate(slicing.match_files(toc, keys.select("book_id", "spine_idx", "file")), anchors, starts)
    return slicing.build_book(blocks, located).drop("doc_key")


def _anchors(found: DataFrame, blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Fragments and their blocks: ids of blocks, and anchors inside or before them."""
    ids = blocks.where("anchor_id IS NOT NULL").select("book_id", "spine_idx", F.col("anchor_id").alias("fragment"), "block_index")
    first = blocks.groupBy("doc_key").agg(F.min("block_index").alias("start"))
    inside = found.where("is_anchor").select("doc_key", F.col("anchor_id").alias("fragment"), "seq").join(first, "doc_key").join(keys, "doc_key")
    return ids.unionByName(inside.select("book_id", "spine_idx", "fragment", (F.col("start") + F.col("seq")).cast("int").alias("block_index")))


def spine_order(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("book_id").orderBy("idx")
    return rows.where("kind = 'spine'").select("book_id", "name", (F.row_number().over(order) - 1).alias("spine_idx"))
