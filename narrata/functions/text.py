"""Text, time and JSON column functions.

Everything here is an expression over built-in functions, so it stays inside
whole-stage code generation. Character classes are spelled out because the
default classes of Java's regular expressions cover ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, its complement, and word characters.
_SPACE_SET = r"\s\x0b\x1c-\x1f\x85\p{Z}"
SPACE = f"[{_SPACE_SET}]"
NOT_SPACE = f"[^{_SPACE_SET}]"
WORD = r"[\p{L}\p{N}_]"

# The same white space as a list of characters.
SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# What cleaning removes, in the order it is removed.
URL = f"http{NOT_SPACE}+|www{NOT_SPACE}+"
MARKDOWN_LINK = r"\[[^\n]*?\]\([^\n]*?\)"
LOOSE_MARKDOWN = r"[`*\[\]()]"
COMMUNITY_MENTION = f"r/{WORD}+"
USER_MENTION = f"u/{WORD}+"

TOKEN = WORD + "{2,}"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    """True when nothing but white space is left; stops at the first other character."""
    return ~text.rlike(NOT_SPACE)


def _replaced_if(text: Column, may: Column, pattern: str) -> Column:
    return F.when(may, F.regexp_replace(text, pattern, "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """Lower-case and remove URLs, link markup and mentions; null gives ''.

    The zero-width-space entity is spelled with a capital B, so it can never
    occur in lower-cased text; there is no step for it.
    """
    low = F.lower(or_empty(text))
    # Looking for a few letters is far cheaper than the patterns, and most texts hold none of them.
    out = _replaced_if(low, low.contains("http") | low.contains("www"), URL)
    out = _replaced_if(out, out.contains("]("), MARKDOWN_LINK)
    out = F.regexp_replace(out, LOOSE_MARKDOWN, "")
    out = F.regexp_replace(out, r"\n\n+", "\n")
    out = _replaced_if(out, out.contains("r/"), COMMUNITY_MENTION)
    out = _replaced_if(out, out.contains("u/"), USER_MENTION)
    out = F.regexp_replace(out, f"{SPACE}{{2,}}", " ")
    return strip(out)


def author_name(author: Column, literal_none: bool = False) -> Column:
    """Author, null for a removed account, or the literal 'None' on request."""
    return F.coalesce(author, F.lit("None")) if literal_none else author


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds to a naive UTC timestamp, whatever the session time zone."""
    return F.timestamp_add("MICROSECOND", (seconds * 1_000_000).cast("bigint"),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def iso_text(ts: Column) -> Column:
    """Naive timestamp to ISO text; a fraction is written in full or not at all."""
    text = F.translate(ts.cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def parse_iso(text: Column) -> Column:
    """ISO text to a naive timestamp; null when it cannot be read."""
    return text.try_cast("timestamp_ntz")


def informativeness(score: Column, body: Column) -> Column:
    """score * ln(1 + number of characters)."""
    return score * F.log1p(F.length(body))


def post_text(title: Column, selftext: Column) -> Column:
    """Title and body as one text; the separator stays when a side is missing."""
    return F.concat(or_empty(title), F.lit(" "), or_empty(selftext))


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
