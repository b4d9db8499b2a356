"""Vectors as arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bound(value: Column, use) -> Column:
    """use(value), the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def renormalised(a: Column) -> Column:
    """a over its length plus a tiny number, so that zero stays zero."""
    return bound(a, lambda v: bound(norm(v) + F.lit(TINY), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def fused(a: Column, b: Column) -> Column:
    """The renormalised sum of two views of one thing."""
    return renormalised(F.zip_with(renormalised(a), renormalised(b), lambda x, y: x + y))
