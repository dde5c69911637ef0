"""Locators: compared forms, parents, depths, natural order, margin keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def margin_key(c: Column) -> Column:
    """A running line's key: lower case, digit runs as '#', other signs as blanks."""
    t = F.regexp_replace(F.lower(c), "[0-9]+", "#")
    t = F.regexp_replace(t, "[^a-z#]+", " ")
    t = F.regexp_replace(t, "(?:#\\s*)+", "# ")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def squeeze_digits(c: Column) -> Column:
    """A locator without the blanks that stand between digits or dots."""
    return F.regexp_replace(c, "(?<=[0-9.])\\s+(?=[0-9.])", "")


def parent(c: Column) -> Column:
    """The locator one step up: without its last (x), /part or .n; null at the top."""
    up = F.regexp_replace(c, "(?:\\([^()]*\\)|/[^/]*|\\.[^./()]*)$", "")
    return F.when((up != c) & (up != ""), up)


def depth(c: Column) -> Column:
    """Steps of a locator: one and its (x), /part and .n members."""
    return F.lit(1) + F.regexp_count(c, F.lit("\\([^()]*\\)|/|\\."))


def natural_key(c: Column, width: int = 9) -> Column:
    """Sorts as numbers where a part is one: digit runs padded to ``width``, longer ones kept."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$") & (F.length(x) < width), F.lpad(x, width, "0")).otherwise(x)), "")


def address(c: Column) -> tuple[Column, Column]:
    """(kind, code) of a locator such as 'section:1.2/list:3'."""
    return F.split_part(c, F.lit(":"), F.lit(1)), F.regexp_replace(c, "^[^:]*:", "")


def normalized_block(c: Column) -> Column:
    """A block as running text: line ends unified, words cut by '-' joined, blanks squeezed."""
    t = F.regexp_replace(c, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "([A-Za-z])-\\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(t, "[ \\t\\n]+", " "))
