"""HTML as text: everything here is a pattern on the page source, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideboard.functions import text as T

CHROME_TAGS = ("nav", "header", "footer", "script", "style")
HIDDEN_TAGS = ("script", "style")

# A value in either kind of quotes, or up to the next space or the tag's end.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
# Opening tag and body of one element without a nested element of the same kind.
LINK = rf"(?is)<a\b[^>]*?\bhref\s*=\s*{VALUE}[^>]*>.*?</a\s*>"
HREF = rf"(?is)^<a\b[^>]*?\bhref\s*=\s*({VALUE})"


def drop_elements(html: Column, tags: Sequence[str]) -> Column:
    """Page source without comments and without the given elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", " ")
    return out


def strip_tags(html: Column, separator: str = " ") -> Column:
    """Text between the tags, words kept apart by the separator."""
    return T.squeeze(T.decode_entities(F.regexp_replace(html, r"<[^>]*>", separator)))


def visible_text(html: Column, drop: Sequence[str] = CHROME_TAGS) -> Column:
    return strip_tags(drop_elements(html, drop))


def text_lines(html: Column, drop: Sequence[str] = HIDDEN_TAGS) -> Column:
    """Array of the non-blank lines of visible text, one line per text node."""
    marked = F.regexp_replace(drop_elements(html, drop), r"<[^>]*>", "\n")
    lines = F.transform(F.split(T.decode_entities(marked), "\n"), T.squeeze)
    return F.filter(lines, lambda line: line != "")


def attribute_value(html: Column, attribute: str) -> Column:
    return T.blank_to_null(unquoted(F.regexp_extract(html, rf"(?is)\b{attribute}\s*=\s*({VALUE})", 1)))


def unquoted(value: Column) -> Column:
    """A value without the quotes around it."""
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def links(html: Column) -> Column:
    """Array of (href, anchor) for every link, in page order."""
    found = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(
            T.decode_entities(unquoted(F.regexp_extract(a, HREF, 1)), in_attribute=True).alias("href"), strip_tags(a).alias("anchor")
        ),
    )
