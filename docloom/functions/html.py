"""HTML column functions, all native expressions."""

import html as html_lib
import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.let import let
from docloom.functions.text import strip

# Fixed value: elements whose text is never content.
BOILERPLATE = ("script", "style", "noscript")


def _without(elements) -> str:
    """Comments and whole elements, in document order, so neither can hide the other."""
    names = "|".join(elements)
    return rf"(?is)<!--.*?(?:-->|\z)|<({names})\b.*?(?:</\1\b[^>]*>|\z)"


def drop_boilerplate(html: Column) -> Column:
    return F.regexp_replace(html, _without(BOILERPLATE), "")


def _char_table(semicolon: bool) -> dict:
    """Named character references of HTML, with or without their closing semicolon."""
    return {
        name.rstrip(";"): char for name, char in html5.items() if name.endswith(";") == semicolon
    }


def _constant_map(entries: dict) -> Column:
    """One literal that Catalyst folds into a map, instead of thousands of plan nodes."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


@lru_cache(maxsize=1)
def _low_codes() -> dict[str, str]:
    """Numbers below 160 that do not stand for their own character: zero, most controls, and
    the range that stands for Windows letters."""
    told = {n: html_lib.unescape(f"&#{n};") for n in range(160)}
    return {str(n): text for n, text in told.items() if text != chr(n)}


def _character(code: Column) -> Column:
    """The character of a number of any size; nothing here can raise.

    Surrogates and numbers beyond Unicode give U+FFFD, noncharacters give nothing.
    """
    odd = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    nothing = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    safe = F.when(odd | code.isNull(), 0xFFFD).otherwise(code)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    low = F.try_element_at(_constant_map(_low_codes()), safe.cast("string"))
    return F.when(nothing & ~odd, "").when(safe < 160, F.coalesce(low, char)).otherwise(char)


def _number(digits: Column, base: int, longest: int) -> Column:
    """Digits as a number; more than ``longest`` of them, zeros aside, are beyond Unicode."""
    bare = F.regexp_replace(digits, "^0+", "")
    value = F.conv(F.when(bare == "", "0").otherwise(F.substring(bare, 1, longest)), base, 10)
    return F.when(F.length(bare) > longest, F.lit(1 << 30)).otherwise(value.cast("long"))


def _decode(piece: Column) -> Column:
    """Text after an '&' with the reference at its start replaced."""
    legacy = _char_table(False)
    prefixes = "|".join(sorted(legacy, key=len, reverse=True))
    numeric = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
    found = F.struct(
        F.regexp_extract(piece, "^#([0-9]+)", 1).alias("number"),
        F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+)", 1).alias("hex"),
        F.when(
            ~piece.startswith("#"),
            F.try_element_at(
                _constant_map(_char_table(True)),
                F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1),
            ),
        ).alias("named"),
        F.when(
            ~piece.startswith("#"),
            F.try_element_at(
                _constant_map(legacy), F.regexp_extract(piece, f"^({prefixes})", 1)
            ),
        ).alias("short"),
    )

    def replaced(at):
        code = F.when(at["number"] != "", _number(at["number"], 10, 7)).otherwise(
            _number(at["hex"], 16, 6)
        )
        return (
            F.when(
                (at["number"] != "") | (at["hex"] != ""),
                F.concat(let(code, _character), F.regexp_replace(piece, numeric, "")),
            )
            .when(
                at["named"].isNotNull(),
                F.concat(at["named"], F.regexp_replace(piece, "^[^;]*;", "")),
            )
            .when(
                at["short"].isNotNull(),
                F.concat(at["short"], F.regexp_replace(piece, f"^(?:{prefixes})", "")),
            )
            .otherwise(F.concat(F.lit("&"), piece))
        )

    return let(found, replaced)


def unescape(text: Column) -> Column:
    """Character references as in HTML text, including those without a semicolon."""

    def decoded(pieces):
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decode)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    def whole(raw):
        pieces = F.split(raw, "&", -1)
        return F.when(~raw.contains("&"), raw).otherwise(let(pieces, decoded))

    return let(text, whole)


def page_title(html: Column) -> Column:
    """Text of the first title element, '' if there is none."""
    return bare_title(drop_boilerplate(html))


def bare_title(bare: Column) -> Column:
    """The same of a page without boilerplate."""
    title = F.regexp_extract(bare, r"(?is)<title\b[^>]*>(.*?)(?:</title\b|\z)", 1)
    return strip(unescape(title))


def article_html(html: Column) -> Column:
    """Inner HTML of the first article element, for pages known to use it as main content."""
    return F.regexp_extract(
        drop_boilerplate(html), r"(?is)<article\b[^>]*>(.*?)(?:</article\b|\z)", 1
    )


# An anchor's attributes with a value, other quoted text, and the end of its tag. A name begins
# only after white space, a quote or a slash, and a quoted value is read as a whole.
_ANCHOR = r"(?i)<a(?=[\s/])"
_PARTS = (
    r"(?<![^\s\"'/])[^\s\"'>/=]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
    r"|\"[^\"]*+\"|'[^']*+'|>"
)
_HREF = r"(?is)^href\s*=\s*"


def _href(after: Column) -> Column:
    """Value of the first href in the rest of an anchor's tag, NULL if there is none."""

    def inside(parts):
        end = F.array_position(parts, ">")
        count = F.when(end > 0, end - 1).otherwise(F.size(parts)).cast("int")
        return F.get(F.filter(F.slice(parts, F.lit(1), count), lambda p: p.rlike(_HREF)), F.lit(0))

    first = let(F.regexp_extract_all(after, F.lit(_PARTS), F.lit(0)), inside)
    return unescape(F.regexp_replace(F.regexp_replace(first, _HREF, ""), "^[\"']|[\"']$", ""))


def link_hrefs(html: Column) -> Column:
    """Non-empty href values of all anchors of the raw page, in document order."""
    visible = F.regexp_replace(html, _without(("script", "style")), "")

    def all_after(pieces):
        return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _href)

    return F.array_remove(F.array_compact(let(F.split(visible, _ANCHOR, -1), all_after)), "")
