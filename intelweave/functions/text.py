"""Text preparation: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metadata import strip

#: Shortest block that isn't dropped as a header or footer, and shortest paragraph.
MIN_BLOCK = 15
MIN_PARAGRAPH = 20
# Lines that number a page or head a table of contents.
PAGE_LINES = r"(?iU)^(page\s+\d+\s+of\s+\d+|\d+\s*/\s*\d+|table\s+of\s+contents)$"


def _lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _squeezed(text: Column, sign: str, run: str, one: str) -> Column:
    """text with runs (a pattern) as one; the pattern is only tried where a text holds sign, the shortest run."""
    tried = lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, run, one)).otherwise(t)
    return F.element_at(F.transform(F.array(text), tried), 1)


def normalize_block(text: Column) -> Column:
    out = _squeezed(_lines(text), "\n\n\n", r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def normalize_whitespace(text: Column) -> Column:
    out = _squeezed(F.replace(_lines(text), F.lit("\t"), F.lit(" ")), "  ", " {2,}", " ")
    return strip(_squeezed(out, "\n\n\n", r"\n{3,}", "\n\n"))


def is_header_or_footer(block: Column) -> Column:
    return (F.length(strip(block)) < MIN_BLOCK) | strip(block).rlike(PAGE_LINES)


def drop_headers_footers(blocks: Column) -> Column:
    """Array of blocks without short ones, page numbers and tables of contents."""
    return F.filter(blocks, lambda b: ~is_header_or_footer(b))


def segment(text: Column, min_length: int = MIN_PARAGRAPH) -> Column:
    """Paragraphs of at least min_length characters, in order."""
    parts = F.transform(F.split(normalize_whitespace(text), "\n\n", -1), strip)
    return F.filter(parts, lambda p: F.length(p) >= min_length)


def context_window(text: Column, start: Column, end: Column, width: int) -> Column:
    """text from width before start to width after end; empty without a width."""
    if width <= 0:
        return F.lit("")
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, F.least(end + width, F.length(text)) - first)
