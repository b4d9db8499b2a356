"""Folio keys: f, leaf number, side r or v, optional panel number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a key that names a leaf, in lower case.
KEY = r"^f0*([0-9]+)([rv][0-9]*)\z"


def folio_form(folio: Column) -> Column:
    """The key trimmed of spaces, in lower case, without leading zeros; null if it names no leaf."""
    key = F.lower(F.trim(folio))
    return F.when(key.rlike(KEY), F.regexp_replace(key, KEY, "f$1$2"))


def leaf_number(form: Column) -> Column:
    """The leaf number of a folio form; null where there is none or it exceeds an int."""
    return F.regexp_extract(form, "^f([0-9]+)", 1).try_cast("int")


FOLIO_FORM_SQL = r"""CASE WHEN regexp_matches(lower(trim({0}, ' ')), '^f0*([0-9]+)([rv][0-9]*)\z')
 THEN regexp_replace(lower(trim({0}, ' ')), '^f0*([0-9]+)([rv][0-9]*)\z', 'f\1\2') END"""


def folio_form_sql(column: str) -> str:
    """The same in DuckDB's SQL."""
    return FOLIO_FORM_SQL.format(column)
