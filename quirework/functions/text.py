"""Keys, labels and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

# The form of a folio key, and the part of an address that names an image in full.
LEAF_KEY = r"^f([0-9]+)([rv])([0-9]+)?\z"
FULL_IMAGE = r"/full/full/0/default\.jpg(\?.*)?$"


def leaf_base(key: Column, strict: bool = False) -> Column:
    """struct(n, side, base) of a folio key, the panel dropped; null for other values, or an error if strict."""
    low = F.lower(key)
    n, side = F.regexp_extract(low, LEAF_KEY, 1).try_cast("int"), F.regexp_extract(low, LEAF_KEY, 2)
    parts = F.struct(n.alias("n"), side.alias("side"), F.concat(n.cast("string"), side).alias("base"))
    wrong = F.raise_error(F.concat(F.lit("no folio key: "), F.coalesce(key, F.lit("null")))).cast("struct<n: int, side: string, base: string>") if strict else F.lit(None)
    return F.when(low.rlike(LEAF_KEY), parts).otherwise(wrong)


def leaf_tokens(label: Column) -> Column:
    """The leaf numbers with side that stand free of other digits in a label, each once, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"(?<![0-9])([0-9]+[rv])(?![0-9])"), 1))


def whole_token(label: Column, token: Column) -> Column:
    """Whether the token stands in the label free of digits, whatever the case."""
    return F.array_contains(leaf_tokens(label), F.lower(token))


def derivative_url(body_id: Column, width: int) -> Column:
    """The address of an image in full, rewritten to one of the given width; other addresses stay."""
    return F.regexp_replace(body_id, FULL_IMAGE, f"/full/{width},/0/default.jpg")


def json_safe(value: Column) -> Column:
    """A number, or null if it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def json_safe_as(value: Column, kind: DataType) -> Column:
    """A value of any type with null for every number in it that is NaN or infinite, however deep in lists, maps and structs."""
    if isinstance(kind, (DoubleType, FloatType)):
        return json_safe(value)
    if not _holds_numbers(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: json_safe_as(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: json_safe_as(x, kind.valueType))
    fields = F.struct(*(json_safe_as(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))
    return F.when(value.isNotNull(), fields)


def _holds_numbers(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_numbers(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_numbers(kind.valueType)
    if isinstance(kind, StructType):
        return any(_holds_numbers(f.dataType) for f in kind.fields)
    return isinstance(kind, (DoubleType, FloatType))
