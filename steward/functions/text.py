"""Text columns: whitespace normalization and digests.

Whitespace here is the Unicode notion (no-break and ideographic spaces, line separators and the
information separators U+001C-U+001F), wider than what `trim` or ASCII `\\s` cover.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: The same characters one by one, for `trim(BOTH chars FROM text)`.
WHITESPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
         *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Every whitespace run becomes one space, none left at either end."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def digest_text(text: Column) -> Column:
    return F.sha2(collapse_whitespace(text), 256)


def normalized_length(text: Column) -> Column:
    return F.length(collapse_whitespace(text))


def name_digest(name: Column) -> Column:
    """Digest of the name exactly as written."""
    return F.sha2(name, 256)


def matches_sql(text: str, pattern: str) -> str:
    """Whole-string match; `$` would accept a trailing newline."""
    return rf"rlike({text}, r'\A(?:{pattern})\z')"


def matches(text: str, pattern: str) -> Column:
    return F.expr(matches_sql(text, pattern))
