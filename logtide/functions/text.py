"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends of a text (fixed values): ASCII blanks, the information separators,
# next line, no-break space and the Unicode space separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def strip(col: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """True for a text without any visible character; stops at the first one it meets."""
    return ~col.rlike(f"[^{WHITESPACE}]")


def clean_text(col: Column, max_len: int | None = None) -> Column:
    """Stripped text, null when blank, cut to ``max_len``."""
    text = F.nullif(strip(col.cast("string")), F.lit(""))
    return F.left(text, F.lit(max_len)) if max_len else text


# The Unicode word-break rule as a search index applies it: words of letters, marks, digits and underscores; an apostrophe,
# dot or colon joins letters, a dot, comma, semicolon or apostrophe joins digits.
TOKEN = (
    r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=[\p{L}\p{M}])['\u2019.:\u00b7](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
)


def tokens(col: Column) -> Column:
    """Lower-cased words of a text by the word-break rule: ``user_id``, ``3.14``, ``10.0.0.5`` and ``can't`` are one each."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def shaped_uuid(hex_text: Column) -> Column:
    """The first 32 hex digits of a text in 8-4-4-4-12 groups. The argument is evaluated once."""
    return F.regexp_replace(F.left(hex_text, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def canonical_uuid(col: Column) -> Column:
    """Lower-case dashed form of a UUID text, null when it is not one."""
    text = F.regexp_replace(strip(col), r"^(?i)(urn:)?(uuid:)?\{?|\}?$", "")
    return F.when(text.rlike(UUID_PATTERN), shaped_uuid(F.lower(F.replace(text, F.lit("-"), F.lit("")))))


def iso_text(col: Column) -> Column:
    """UTC timestamp as ISO 8601 text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
