"""Text clean-up: whitespace, slugs, title suffixes, code fences, dates, file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Title separators trimmed, and the characters kept in a file name.
TITLE_SEPARATOR = "(?U)\\s+[|–—-]\\s+"
UNSAFE_NAME = r"[^A-Za-z0-9._-]+"


def or_else(text: Column, default: Column) -> Column:
    """``text``, or ``default`` when it is empty or NULL; ``text`` is written once in the plan."""
    return F.coalesce(F.nullif(text, F.lit("")), default)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (plain ``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_ws(text: Column) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slugify(title: Column) -> Column:
    """Lower-case ASCII slug; 'page' when nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return or_else(slug, F.lit("page"))


def trim_title_suffix(title: Column) -> Column:
    """First part before a spaced `|` or dash, the whole title when that part is empty."""
    stripped = strip(title)
    first = strip(F.get(F.split(stripped, TITLE_SEPARATOR), F.lit(0)))
    return or_else(first, stripped)


def strip_code_fence(text: Column) -> Column:
    """Remove a leading ```lang line and a trailing ``` line."""
    return strip(F.regexp_replace(strip(text), r"\A```[a-zA-Z]*\n|\n```\z", ""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def rfc1123(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def gmt_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
