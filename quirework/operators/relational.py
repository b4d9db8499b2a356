"""Small relational operators: theta joins as equi-joins, lookups, frequencies, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, l_key: str, r_key: str, reach: int) -> DataFrame:
    """Rows whose whole-number keys differ by at most reach: each left row asks for 2 * reach + 1 keys by an equi-join."""
    asked = left.withColumn("__k", F.explode(F.sequence(F.col(l_key) - reach, F.col(l_key) + reach)))
    return asked.join(right, F.col("__k") == F.col(r_key)).drop("__k")


def lookup(rows: DataFrame, names: DataFrame, keys: list[str], value: str, default: Column | None = None) -> DataFrame:
    """rows with the value of names for their key, or the default; keys of names count once, by their smallest value."""
    once = names.groupBy(*keys).agg(F.min(value).alias(value))
    found = rows.join(once, keys, "left")
    return found if default is None else found.withColumn(value, F.coalesce(F.col(value), default))


def most_common(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, value, n, rank): the most frequent values of each group, ties by value; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def argmax(rows: DataFrame, group: list[str], order: Column) -> DataFrame:
    """The row of each group with the largest order, whole."""
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def first_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def token_jaccard(rows: DataFrame, key: str, text: str, other: str) -> DataFrame:
    """(key, jaccard) of the word sets of two texts of a row; null if both are empty."""
    def words(c: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z]+"), lambda w: w != ""))

    union = F.size(F.array_union(words(text), words(other)))
    return rows.select(key, F.when(union > 0, F.size(F.array_intersect(words(text), words(other))) / union).alias("jaccard"))


def zero_filled(counts: DataFrame, upto: int, key: str, n: str) -> DataFrame:
    """Counts of 0 .. upto - 1, with 0 for those that don't occur."""
    every = counts.sparkSession.range(upto).select(F.col("id").alias(key))
    return every.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))
