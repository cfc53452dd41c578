"""Tokeniser and plain-text column functions."""

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters, numbers and private-use characters.
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"

# Combining marks that are dropped from inside a token. All others end it.
DROPPED_MARKS = (
    r"[\u0300-\u0304\u0306-\u030C\u030F\u0311\u031B\u0323-\u0328\u032D\u032E\u0330\u0331]"
)

# Case-folding pairs that lower-casing alone does not give.
FOLD_PAIRS = {
    "µ": "μ",
    "ſ": "s",
    "ẛ": "s",
    "ς": "σ",
    "ϐ": "β",
    "ϑ": "θ",
    "ϕ": "φ",
    "ϖ": "π",
    "ϰ": "κ",
    "ϱ": "ρ",
    "ϵ": "ε",
}


def _fold_map() -> tuple[str, str]:
    """Lower-case letters that are one ASCII letter plus exactly one mark, and their base."""
    pairs = dict(FOLD_PAIRS)
    for code in range(0x80, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            pairs.setdefault(chr(code), parts[0])
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_map()
# Characters without a counterpart in _TO are dropped, in the same pass.
_DROPPED = "".join(filter(re.compile(DROPPED_MARKS).match, map(chr, range(0x300, 0x370))))


def fold(text: Column) -> Column:
    lowered = F.lower(text)
    accented = F.translate(lowered, _FROM + _DROPPED, _TO)
    return F.when(F.octet_length(lowered) > F.char_length(lowered), accented).otherwise(lowered)


def tokenize(text: Column) -> Column:
    """Tokens of ``text`` in order, case-folded and without single accents."""
    return F.array_remove(F.split(fold(text), TOKEN_BREAK), "")


def normalize_text(text: Column) -> Column:
    """Unify line ends, limit blank lines, then collapse spaces and strip."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.regexp_replace(lines, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(lines, r"[ \t]{2,}", " "))


# Fixed value: what ``strip`` leaves in place.
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(F.regexp_replace(text, "^" + space, ""), space + r"\z", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def title_or_url(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), url)
