"""HTML character references as column expressions, decoded as browsers and Python's html.unescape do."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference: numeric, or a name of up to 32 characters that may lack its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

#: Bytes 0x80 to 0x9F stand for what they are in Windows-1252; its five gaps stay control characters.
WINDOWS = {code: bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)}


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(digits: Column, base: int) -> Column:
    """What a numeric reference stands for: numbers out of range are U+FFFD, control characters and noncharacters nothing."""
    short = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(short) > 8, 0x110000).otherwise(F.coalesce(F.conv(F.when(short == "", "0").otherwise(short), base, 10).cast("long"), F.lit(0x110000)))
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair]), code.cast("int")), F.lit(None).cast("string"))
    dropped = ((code >= 1) & (code < 9)) | (code == 0xB) | ((code >= 0xE) & (code < 0x20)) | (code == 0x7F) | ((code >= 0xFDD0) & (code < 0xFDF0)) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    replaced = (code == 0) | ((code >= 0xD800) & (code < 0xE000)) | (code > 0x10FFFF)
    return F.when(code == 0xD, "\r").when(mapped.isNotNull(), mapped).when(replaced, "�").when(dropped, "").otherwise(_character(F.when(replaced | dropped, 65).otherwise(code)))


def _named(name: Column, table: Column) -> Column:
    """What a name stands for: itself, or its longest beginning that is a name; else it stays as it is, with its ampersand."""
    sizes = F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1))
    known = F.when(F.length(name) > 2, F.get(F.filter(sizes, lambda n: F.element_at(table, F.substring(name, F.lit(1), n)).isNotNull()), F.lit(0)))
    shorter = F.concat(F.element_at(table, F.substring(name, F.lit(1), known)), F.substring(name, known + 1, F.length(name)))
    return F.coalesce(F.element_at(table, name), shorter, F.concat(F.lit("&"), name))


def html_unescape(text: Column) -> Column:
    """The text with all its character references resolved, once (`&amp;lt;` gives `&lt;`). Null stays null."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # a constant, folded once

    def decoded(name: Column) -> Column:
        bare = F.regexp_replace(name, ";$", "")
        return F.when(bare.rlike("^#[xX]"), _numeric(F.substring(bare, 3, 40), 16)).when(bare.startswith("#"), _numeric(F.substring(bare, 2, 40), 10)).otherwise(_named(name, table))

    names = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    parts = F.split(text, REFERENCE, -1)
    joined = F.array_join(F.zip_with(parts, names, lambda part, name: F.concat(part, F.coalesce(decoded(name), F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)
