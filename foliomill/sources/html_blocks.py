"""Semantic blocks of XHTML documents: paragraphs, headings, quotes, list items and images in reading order.

A small tree builder on the standard library's tokenizer, one document at a time inside mapInPandas; everything after it
(numbering, slicing, cleaning) is DataFrame work.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import clean_book_text

# What is removed, gone into, and what has no end tag.
REMOVED = frozenset({"script", "style", "nav", "noscript"})
CONTAINERS = frozenset({"div", "section", "article", "main", "header", "footer", "ol", "ul", "dl", "aside"})
LEAVES = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li"})
VOID = frozenset({"br", "img", "hr", "meta", "link", "input"})
KINDS = {"p": "paragraph", "blockquote": "quote", "li": "list_item"}


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.name not in REMOVED:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Tree(HTMLParser):
    """End tags close the nearest open element of their name; without one they are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def blocks_of(source: str) -> tuple[list[tuple[str, str, int | None, str, str | None, str | None]], dict[str, int]]:
    """Blocks (raw text, type, level, tag, id, image source) and the block of each anchor."""
    tree = _Tree()
    tree.feed(source)
    tree.close()
    body = next((n for n in tree.root.walk() if n.name == "body"), tree.root)
    blocks: list[tuple] = []
    of_node: dict[int, int] = {}

    def add(node: Node, text: str, kind: str, level: int | None = None, src: str | None = None) -> None:
        of_node.setdefault(id(node), len(blocks))
        blocks.append((text, kind, level, node.name, node.attrs.get("id"), src))

    def images(node: Node) -> None:
        for n in node.walk():
            if n.name == "img":
                add(n, n.attrs.get("alt", ""), "image", src=n.attrs.get("src", ""))

    stack: list[Node | str] = list(reversed(body.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.name in REMOVED:
            continue
        has_image = node.name in ("img", "figure") and any(n.name == "img" for n in node.walk())
        if has_image:
            images(node)
        elif node.name in LEAVES:
            text = html.unescape(node.text())
            if text.strip():
                level = int(node.name[1]) if node.name[0] == "h" else None
                add(node, text, KINDS.get(node.name, "heading"), level)
            if node.name == "p":
                images(node)
        elif node.name in CONTAINERS or node.name == "figure":
            stack.extend(reversed(node.children))

    anchors: dict[str, int] = {}
    for a in tree.root.walk():
        if a.name != "a" or "id" not in a.attrs:
            continue
        leaf = a.parent
        while leaf is not None and leaf.name not in LEAVES:
            leaf = leaf.parent
        if leaf is None:
            continue
        found = of_node.get(id(leaf))
        if found is None and leaf.parent is not None:
            siblings = [c for c in leaf.parent.children if isinstance(c, Node)]
            after = siblings[siblings.index(leaf) + 1 :]
            following = next((s for s in after if s.name in LEAVES | {"div", "section", "article"}), None)
            found = of_node.get(id(following)) if following is not None else None
        if found is None and blocks:
            found = 0
        if found is not None:
            anchors[a.attrs["id"]] = found
    for node in tree.root.walk():  # parents and children hold each other: without this a tree waits for the collector
        node.parent = None
    return blocks, anchors


_SCHEMA = "doc_key long, seq int, raw string, type string, level int, tag string, anchor_id string, image_src string, is_anchor boolean"


#: Characters of XHTML, about, that a task of `extract` holds as trees and rows at a time.
CHUNK = 2_000_000


def extract(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """Rows of blocks (is_anchor false) and of anchors (anchor_id, seq of their block) of every document.

    An Arrow batch may hold 10,000 documents: their texts are taken out of it one by one, and rows leave as soon as CHUNK characters are read.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SCHEMA.split(", ")])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], 0
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                k, text = k.as_py(), text.as_py() or ""
                blocks, anchors = blocks_of(text)
                rows += [(k, i, *b, False) for i, b in enumerate(blocks)]
                rows += [(k, at, None, None, None, "a", name, None, True) for name, at in anchors.items()]
                seen += len(text)
                if seen >= CHUNK:
                    yield packed(rows)
                    rows, seen = [], 0
            yield packed(rows)

    return pages.select(F.col(key).cast("long").alias("k"), F.col(source).alias("s")).mapInArrow(run, _SCHEMA)


def blocks(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """Cleaned blocks: doc_key, seq (0-based, gapless), type, level, tag, anchor_id, image_src, text.

    A block whose text is cleaned away is left out, images excepted.
    """
    from pyspark.sql import Window as W

    found = extract(pages, key, source).where("NOT is_anchor").withColumn("text", F.when(F.col("type") == "image", F.col("raw")).otherwise(clean_book_text(F.col("raw"))))
    kept = found.where("type = 'image' OR text <> ''")
    return kept.withColumn("seq", (F.row_number().over(W.partitionBy("doc_key").orderBy("seq")) - 1).cast("int")).drop("raw", "is_anchor")
