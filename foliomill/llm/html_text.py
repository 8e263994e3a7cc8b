"""Layout-aware rendering of HTML to text.

A tree builder with implied tags keeps the open elements of a page; what it opens and closes drives a renderer that
emits all visible text: blocks on lines of their own with blank lines where browsers leave space, lists with
bullets, numbers and indentation, tables with aligned cells, preformatted text as it is, formulas and the labels of
inline graphics as running text. Scripts, styles, the head, what inline graphics and formulas only describe or define, and whatever is hidden by attribute or inline style are left out.

Visibility is inherited as in browsers: `display: none` hides all inside, `visibility: hidden` what does not ask to
be visible again. Cells that span columns or rows keep later cells in their columns.

Pages are rows of a DataFrame; each Arrow batch is rendered page by page, so memory depends on the longest page. The
time for a page grows with its length, however its markup is nested or left unclosed: the scanner reads each character
a bounded number of times and open elements are found by name. For this, indentation grows over the first
`DEEPEST_INDENT` levels only, tables inside `DEEPEST_TABLE` others are laid out as running blocks, and spans count up to
`WIDEST_SPAN`; no text is left out.

Defined results: null HTML gives empty text; markup errors never fail, stray end tags are ignored, open elements end with
the page, and a tag that the page ends in is no text, as in browsers; equal rows give equal results; an empty table gives
no rows; a column named `text` is replaced, others are carried along.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: element classes and which start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist map".split())
FOREIGN = frozenset("svg math".split())
#: Elements of SVG and MathML that are not drawn where they stand.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir".split())
BLOCK = SPACED | frozenset("html body div section article main header footer nav aside address form figcaption details summary hgroup legend li dt dd center dialog optgroup option search tr caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = SPACED | frozenset("address article aside center details dialog div dd dt footer form header hgroup hr li main nav section summary search fieldset figcaption".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: Start tag -> (open elements that it ends, elements beyond which it does not look).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
}
SCOPE = frozenset("td th table caption html".split())

# Possessive repeats never go back, and an end of the page ends any tag: no start is tried in vain.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Cells wider than this do not widen their column further.
WIDEST_CELL = 80
#: More columns or rows than these are not counted for one cell.
WIDEST_SPAN = 1000
DEEPEST_TABLE = 16
DEEPEST_INDENT = 32


class Page:
    """Lines of rendered text, with pending space between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.last = ""
        self.open = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if not self.open:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            indent = "".join(self.indents[:DEEPEST_INDENT])
            if self.marker:
                indent = indent[: max(len(indent) - len(self.marker), 0)] + self.marker
                self.marker = ""
            self.parts, self.open = [indent], True
            self.fresh = True

    def _add(self, s: str) -> None:
        self._begin()
        self.parts.append(s)
        self.last, self.fresh = s[-1], False

    def text(self, s: str) -> None:
        s = BLANKS.sub(" ", s)
        if not self.open:
            s = s.lstrip(" ")
        elif s.startswith(" ") and (self.fresh or self.last == " "):
            s = s[1:]
        if s:
            self._add(s)

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.split("\n")):
            if i:
                self.end_line(keep=True)
            if part:
                self._add(part)

    def end_line(self, keep: bool = False) -> None:
        if self.open:
            self.lines.append("".join(self.parts).rstrip())
        elif keep:
            self.lines.append("")
        self.open = False

    def block(self, blank: int) -> None:
        self.end_line()
        self.gap = max(self.gap, blank)

    def add_lines(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self.parts.append(line)
            self.end_line()

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


@dataclass
class Cell:
    """Lines of a cell, the columns and rows that it spans, and its first column."""

    lines: list[str]
    wide: int
    high: int
    column: int = 0


def place_cells(rows: list[list[Cell]]) -> None:
    """Give each cell the first column that no earlier cell of its row, or a higher one from above, takes."""
    taken: list[tuple[int, int, int]] = []  # (first column, column after the last, row after the last), in order
    for r, row in enumerate(rows):
        taken = [x for x in taken if x[2] > r]
        column = nth = 0
        added = []
        for cell in row:
            while nth < len(taken) and taken[nth][0] <= column:
                column = max(column, taken[nth][1])
                nth += 1
            cell.column = column
            column += cell.wide
            if cell.high > 1:
                added.append((cell.column, column, r + cell.high))
        if added:
            taken = sorted(taken + added)


def table_lines(rows: list[list[Cell]]) -> list[str]:
    """Rows as lines with aligned columns; only columns that some cell begins in have a width of their own."""
    place_cells(rows)
    begins = sorted({cell.column for row in rows for cell in row})
    spans = [[(bisect_left(begins, c.column), bisect_left(begins, c.column + c.wide)) for c in row] for row in rows]
    widths = [0] * len(begins)
    for row, places in zip(rows, spans, strict=True):
        for cell, (first, end) in zip(row, places, strict=True):
            if end == first + 1:
                widths[first] = max(widths[first], min(max(map(len, cell.lines), default=0), WIDEST_CELL))
    offsets = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for row, places in zip(rows, spans, strict=True):
        # Cells that have ended leave room only before one that has not.
        lasting = sorted(range(len(row)), key=lambda i: -len(row[i].lines))
        for k in range(max((len(c.lines) for c in row), default=0)):
            while lasting and len(row[lasting[-1]].lines) <= k:
                lasting.pop()
            line: list[str] = []
            at = behind = 0
            for i in sorted(lasting):
                first, end = places[i]
                start = max(offsets[first] + behind, at)
                line += [" " * (start - at), row[i].lines[k], "  "]
                at = start + len(row[i].lines[k]) + 2
                behind = max(at - offsets[end], 0)
            out.append("".join(line).rstrip())
    return out


@dataclass
class Element:
    tag: str
    hidden: bool  # by itself, with all inside
    unseen: bool  # by visibility
    closed: bool = False  # details that are not open
    laid_out: bool = False  # a cell with a page of its own


class Builder:
    """Open elements, and the page that each of them writes to."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.where: dict[str, list[int]] = {}
        self.pages = [Page()]
        self.tables: list[list[list[Cell]] | None] = []  # None: too deep for a layout of its own
        self.lists: list[int | None] = []
        self.spans: list[tuple[int, int]] = []
        self.hidden = 0
        self.pre = 0

    def near(self, tags, stop) -> int:
        """Index of the nearest open element among tags, -1 if one of stop comes first."""
        found = max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)
        return found if all(self.where[t][-1] <= found for t in stop if self.where.get(t)) else -1

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and (i := self.near({"p"}, SCOPE)) >= 0:
            self.close(i)
        if tag in HEADINGS and self.open and self.open[-1].tag in HEADINGS:
            self.close(len(self.open) - 1)
        if tag in ENDS:
            tags, stop = ENDS[tag]
            while (i := self.near(tags, stop)) >= 0:
                self.close(i)
        if tag in CELLS or tag == "tr" or tag in SECTIONS or tag == "caption":
            if self.near({"table"}, ()) < 0:
                return  # parts of a table outside any table
            if tag in CELLS and self.near({"tr"}, {"table"}) < 0:
                self.enter("tr", {})
        given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\n\t") else {}
        if tag in VOID:
            self.void(tag, given)
        elif not self.ends_itself(attributes):
            self.enter(tag, given)

    def foreign(self) -> bool:
        return self.near(FOREIGN, {"foreignobject"}) >= 0

    def ends_itself(self, attributes: str) -> bool:
        """Whether the tag is one like <defs/>, which only SVG and MathML have."""
        return attributes.endswith("/") and self.foreign()

    def void(self, tag: str, given: dict[str, str]) -> None:
        if self.hidden:
            return
        page = self.pages[-1]
        unseen = self.unseen(given)
        if tag == "br":
            page.end_line(keep=True)
        elif tag == "hr":
            page.block(1)
        elif tag == "input" and given.get("type", "").lower() in ("submit", "button", "reset") and "hidden" not in given and not unseen:
            page.text(given.get("value", ""))

    def unseen(self, given: dict[str, str]) -> bool:
        """Whether visibility hides an element that begins here."""
        asked = VISIBILITY.findall(given.get("style", ""))
        return asked[-1].lower() != "visible" if asked else bool(self.open) and self.open[-1].unseen

    def enter(self, tag: str, given: dict[str, str]) -> None:
        hidden = tag in HIDDEN or "hidden" in given or bool(NO_DISPLAY.search(given.get("style", ""))) or tag == "dialog" and "open" not in given
        hidden = hidden or tag != "summary" and self.in_closed_details() or tag in UNDRAWN and self.foreign()
        label = tag == "text" and self.foreign()
        element = Element(tag, hidden, self.unseen(given), tag == "details" and "open" not in given)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append(element)
        self.hidden += hidden
        if self.hidden:
            return
        page = self.pages[-1]
        if label:
            page.text(" ")
        if tag in BLOCK:
            page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 0)
        if tag in ("ul", "ol", "menu", "dir"):
            start = given.get("start", "1")
            self.lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)
            page.indents.append("   " if tag == "ol" else "  ")
        elif tag == "li":
            marker = "- "
            if self.lists and self.lists[-1] is not None:
                marker = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            page.marker = "" if element.unseen else marker
        elif tag in ("dd", "blockquote"):
            page.indents.append("    ")
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append([] if len(self.tables) < DEEPEST_TABLE else None)
        elif tag == "tr" and self.tables and self.tables[-1] is not None:
            self.tables[-1].append([])
        elif tag in CELLS and self.tables and self.tables[-1] is not None:
            self.spans.append((_span(given.get("colspan", "1")), _span(given.get("rowspan", "1"))))
            self.pages.append(Page())
            element.laid_out = True
        elif tag in CELLS:
            page.text(" ")
        elif tag == "q" and not element.unseen:
            page.text('"')

    def in_closed_details(self) -> bool:
        return bool(self.open) and self.open[-1].closed

    def close(self, index: int) -> None:
        """Close the element at index and all inside it."""
        while len(self.open) > index:
            element = self.open.pop()
            tag = element.tag
            self.where[tag].pop()
            if self.hidden:
                self.hidden -= element.hidden
                continue
            page = self.pages[-1]
            if element.laid_out:
                lines = self.pages.pop().result()
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append(Cell(lines, *self.spans.pop()))
                continue
            if tag == "table" and self.tables and (rows := self.tables.pop()) is not None:
                page.add_lines(table_lines(rows))
            if tag in ("ul", "ol", "menu", "dir"):
                page.end_line()
                page.indents.pop()
                self.lists.pop()
            elif tag in ("dd", "blockquote"):
                page.end_line()
                page.indents.pop()
            elif tag == "li":
                page.end_line()
                page.marker = ""
            elif tag == "pre":
                self.pre -= 1
            elif tag == "q" and not element.unseen:
                page.text('"')
            if tag in BLOCK:
                page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 0)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.void("br", {})
        elif tag not in VOID:
            stop = {"table"} if tag in CELLS or tag == "tr" or tag in SECTIONS else () if tag == "table" else SCOPE
            i = self.near({tag}, stop)
            if i >= 0 and tag not in ("html", "body"):
                self.close(i)

    def data(self, s: str) -> None:
        if s and not self.hidden and not (self.open and (self.open[-1].closed or self.open[-1].unseen)):
            s = html.unescape(s) if "&" in s else s
            if self.open and self.open[-1].tag in ("table", "tr") or self.open and self.open[-1].tag in SECTIONS:
                if not s.strip():
                    return
            if self.pre:
                self.pages[-1].verbatim(s)
            else:
                self.pages[-1].text(s)


def _span(given: str) -> int:
    return min(max(int(given), 1), WIDEST_SPAN) if re.fullmatch(r"[0-9]{1,9}", given.strip()) else 1


def render(source: str | None) -> str:
    """Visible text of a page."""
    if not source:
        return ""
    builder, at, raw = Builder(), 0, re.compile("")
    while (m := TOKEN.search(source, at)) is not None:
        builder.data(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        whole = tag in RAW and builder.ends_itself(m[3])
        builder.start(tag, m[3])
        if tag in RAW and not whole:
            raw = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            stop = raw.search(source, at)
            builder.data(source[at : stop.start() if stop else len(source)])
            at = stop.end() if stop else len(source)
            builder.end(tag)
    builder.data(source[at:])
    builder.close(0)
    return "\n".join(builder.pages[0].result())


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """Replace the column of HTML by `text`, the page's visible text."""
    pages = pages.drop("text") if source != "text" else pages
    at = pages.columns.index(source)
    kept = [f for f in pages.schema if f.name != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render(x.as_py()) for x in batch.column(at)], pa.string())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [texts], names=[n for i, n in enumerate(names) if i != at] + ["text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.mapInArrow(run, f"{fields}text string")
