r"""Text functions of the document structure and matching stages, as column expressions.

Java's classes are ASCII unless a pattern starts with (?U); patterns here that must see all white space, letters or
digits say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.entities import html_unescape

# Prefixes and suffixes that make a hyphenated word certain.
PREFIXES = (
    "anti", "auto", "bi", "co", "counter", "de", "dis", "down", "extra", "fore", "hyper", "il", "im", "in", "inter",
    "ir", "macro", "mal", "micro", "mid", "mis", "mono", "multi", "non", "out", "over", "poly", "post", "pre", "pro",
    "re", "semi", "sub", "super", "tele", "trans", "tri", "ultra", "un", "under", "up",
)
SUFFIXES = (
    "able", "age", "al", "ance", "ant", "ary", "dom", "ed", "en", "ence", "er", "est", "ful", "hood", "ial", "ian",
    "ible", "ic", "ical", "ing", "ion", "ious", "ish", "ist", "ity", "ive", "ization", "ize", "less", "like", "ling",
    "logy", "ly", "ment", "ness", "or", "ous", "ry", "ship", "sion", "some", "tail", "tion", "ture", "ty", "ward",
    "wise", "y",
)

# Patterns of chapter headings, matched at the start of the stripped text.
HEADINGS = (
    r"(?iu)^(chapter|ch\.?)\s+\d+[\.:]?\s*$",
    r"(?iu)^(chapter|ch\.?)\s+(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)\b",
    r"(?iu)^(part|pt\.?)\s+\d+[\.:]?\s*$",
    r"(?iu)^(introduction|preface|prologue|epilogue|appendix|index|bibliography|foreword|acknowledgements?|about the author|afterword|conclusion|summary|notes|references?)\b",
    r"^第\s*[\d一二三四五六七八九十百千]+\s*[章节篇部]",
    r"^第\s*[\d一二三四五六七八九十百千]+\s*[部卷编]",
    r"^(前言|序[言文]?|楔子|引[子言]|后记|尾声|附录|目录|参考文献|作者简介|鸣谢|致谢|写在前面|写在最后)",
    r"^[IVXLCDM]{2,}\.",
)

# Fixed value: how each of these patterns begins. Splitting words at capitals changes no first two characters of a heading.
HEADING_STARTS = r"^(?:(?iu:ch|pa|pt|in|pr|ep|ap|bi|fo|ac|ab|af|co|su|no|re)|[第前序楔引后尾附目参作鸣致写]|[IVXLCDM]{2})"

# Fixed value: a text of these characters only is garbage.
PUNCTUATION_ONLY = "^[\\s\\-–—•· ﻿.,;:!?\"'‘()\\[\\]{}<>«»‥…・《》、，。；：？！【】「」『』〔〕]+$"

FULL_TEXT, FRONT_MATTER, WHOLE_BOOK = "全文", "Front Matter", "全书"


# Fixed value: all white space of Unicode, as (?U)\\s. Trimming looks at the ends only, a pattern at every character.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def strip_left(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


def strip_right(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def non_space_count(x: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s", ""))


def meaningful_ratio(x: Column) -> Column:
    """Share of letters, digits and CJK signs among the characters that are not white space; 0 if there are none."""
    kept = F.length(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}一-鿿㐀-䶿぀-ヿ가-힯]", ""))
    total = non_space_count(x)
    return F.when(total == 0, 0.0).otherwise(kept / total)


def replacement_ratio(x: Column) -> Column:
    """Share of U+FFFD among the characters that are not white space."""
    body = F.coalesce(x, F.lit(""))
    total = non_space_count(x)
    return F.when(total == 0, 0.0).otherwise((F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit("")))) / total)


def is_garbage(x: Column) -> Column:
    body = F.coalesce(x, F.lit(""))
    return (strip(body) == "") | body.rlike("(?U)" + PUNCTUATION_ONLY)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of an x that is computed once, not at each place that f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# Fixed value: a class with all white space of (?U)\s and some other signs, quicker to test. It only tells which texts need the exact patterns.
_MAYBE_SPACE = r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u3000]"


def clean_pdf_text(x: Column) -> Column:
    """Collapse spaces, and close them up before closing and after opening punctuation.

    The three patterns test every character of a text for Unicode's white space; most texts hold none of what they replace and pass by.
    """

    def closed_up(x: Column) -> Column:
        x = F.regexp_replace(x, " {2,}", " ")
        x = F.regexp_replace(x, r"(?U)\s+([,.:;!?)\]}>%])", "$1")
        return F.regexp_replace(x, r"(?U)([\[({¿¡])\s+", "$1")

    def spaced(x: Column) -> Column:
        return F.contains(x, F.lit("  ")) | x.rlike(rf"[,.:;!?)\]}}>%\[({{¿¡](?:(?<={_MAYBE_SPACE}[,.:;!?)\]}}>%])|(?<=[\[({{¿¡])(?={_MAYBE_SPACE}))")

    return strip(_once(x, lambda v: F.when(spaced(v), closed_up(v)).otherwise(v)))


def clean_book_text(x: Column) -> Column:
    """Clean-up of text from XHTML whose entities are resolved: special spaces and hyphens, split words, spacing."""
    x = F.replace(x, F.lit(" "), F.lit(" "))
    x = F.replace(x, F.lit("­"), F.lit(""))
    x = F.regexp_replace(x, "[‐‑]", "-")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, r"(?U)([a-z])-\s+([a-z])", "$1$2")
    x = F.regexp_replace(x, r"(?U)\s+([,.:;!?)\]}>%])", "$1")
    return strip(x)


def clean_epub_text(x: Column) -> Column:
    """Clean-up of text from XHTML with its character references still in it."""
    return clean_book_text(html_unescape(x))


def normalise_for_match(x: Column) -> Column:
    """Lower case, single spaces, no hyphens and no punctuation."""
    x = _once(strip(F.lower(x)), lambda v: F.when(F.contains(v, F.lit("  ")) | v.rlike("[^ -~]"), F.regexp_replace(v, r"(?U)\s+", " ")).otherwise(v))
    for hyphen in "-‐‑":
        x = F.replace(x, F.lit(hyphen), F.lit(""))
    return strip(F.regexp_replace(x, r"(?U)[^\w\s]", ""))


def html_escape(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def camel_split(x: Column) -> Column:
    return F.regexp_replace(x, "([a-z])([A-Z][a-z])", "$1 $2")


def is_heading(x: Column) -> Column:
    """The stripped text, or its camel-split form, starts like a chapter."""
    body = strip(x)
    pattern = "^(?:" + "|".join(f"(?:{p})" for p in HEADINGS) + ")"
    return (body != "") & F.substring(body, 1, 2).rlike(HEADING_STARTS) & (body.rlike(pattern) | camel_split(body).rlike(pattern))


def ends_sentence(x: Column) -> Column:
    """Whether a text ends in a full stop, question or exclamation mark, or these stand before its last line's end."""
    return F.substring(x, -3, 3).rlike(r"[.!?]$")


def starts_lower(x: Column) -> Column:
    return x.rlike(r"^\p{Ll}")


def starts_upper(x: Column) -> Column:
    return x.rlike(r"^\p{Lu}")


def joins_by_hyphen(first: Column, second: Column) -> Column:
    """Whether two parts of a hyphenated word are surely one word."""
    both = F.length(first) + F.length(second)
    certain = F.lower(second).isin(*SUFFIXES) | F.lower(first).isin(*PREFIXES) | (~starts_upper(first) & ~starts_upper(second) & (both >= 6))
    return (F.length(first) > 2) & (F.length(second) > 2) & (both >= 5) & certain


def needs_space(before: Column, after: Column, gap: Column, char_width: Column) -> Column:
    """Whether two boxes of one line are words apart."""
    return (before != "") & (after != "") & ~before.endswith("-") & ~after.rlike(r"^[,.:;!?)\]}%>]") & (gap >= char_width * 0.5)


def source_hash(x: Column) -> Column:
    return F.md5(x)


def file_extension(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"\.[^.]+$", 0))


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]", "_")
