"""String expressions with the whitespace and formatting rules the reports need."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character str.strip() treats as blank.
_BLANK = r"\s\x1c-\x1f"
# Fixed value: every separator str.splitlines() breaks at.
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

DASH = "—"


def is_blank(c: Column) -> Column:
    """True where nothing but whitespace (any Unicode kind) is in the text; null stays null."""
    return ~c.rlike(f"(?U)[^{_BLANK}]")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^[{_BLANK}]+|[{_BLANK}]+$", "")


def split_lines(c: Column) -> Column:
    return F.split(c, _LINE_BREAK)


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def title_words(c: Column) -> Column:
    """``snake_case`` as title-cased words."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def format_or_dash(c: Column, digits: int) -> Column:
    """The number with ``digits`` decimals, a dash where it is null."""
    return (
        F.when(c.isNull(), DASH)
        .when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .otherwise(F.format_string(f"%.{digits}f", c))
    )


def json_text(c: Column) -> Column:
    """A string as a JSON string literal, ``null`` where it is null."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    )


def strict_json(c: Column) -> Column:
    """The JSON document a text is, as a variant; null if anything else stands in it.

    The parser stops at the end of a document. Here the document is the first of two items,
    the other one being drawn at random: text that closes the array itself cannot know it.
    """
    end = uuid.uuid4().hex
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{end}"]')))
    items = F.try_variant_get(both, "$", "array<variant>")
    last = F.try_variant_get(F.try_element_at(items, F.lit(2)), "$", "string")
    return F.when((F.size(items) == 2) & (last == end), F.try_element_at(items, F.lit(1)))


def project_slug(c: Column) -> Column:
    """A short project name out of a path, URL or dataset id."""
    base = F.split_part(F.split_part(c, F.lit("/"), F.lit(-1)), F.lit("."), F.lit(1))
    return F.left(F.lower(F.replace(base, F.lit(" "), F.lit("-"))), F.lit(40))
