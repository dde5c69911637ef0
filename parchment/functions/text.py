"""Scalar text functions as Columns (JVM side) and the few that need Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

BLANKS = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def locator(c: Column) -> Column:
    """A locator's compared form: lower case, no outer blanks."""
    return F.lower(strip(c))


@F.pandas_udf(T.StringType())
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """Text in canonical composition; only text outside ASCII visits Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def title(c: Column) -> Column:
    """A title's compared form: composed accents, lower case, single blanks, no full stops at the end."""
    plain = F.regexp_replace(F.lower(composed(c)), BLANKS, " ")
    return F.regexp_replace(F.regexp_replace(plain, r"^ | $", ""), r"[. ]+$", "")


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
