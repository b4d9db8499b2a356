"""Deterministic samples of the audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import SEED
from quirework.functions.hashing import position


def first_byte(*parts: Column | str, prefix: str = "") -> Column:
    """The first byte of SHA-256 of the parts joined by ':', after the prefix, if any, and the seed."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    start = f"{prefix}:{SEED}" if prefix else str(SEED)
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(start), *texts), 256), 1, 2), 16, 10).cast("int")


def byte_sample(rows: DataFrame, parts: list[str], below: int, prefix: str = "", most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows whose first byte is below a limit; of these at most `most` in the given order."""
    drawn = rows.where(first_byte(*parts, prefix=prefix) < below)
    return drawn if most is None else drawn.orderBy(*(order or parts)).limit(most)


def stratified_cap(rows: DataFrame, stratum: str, key: str, most: int, least_each: int = 20) -> DataFrame:
    """At most max(least_each, most / strata) rows of each stratum, in hash order, and at most `most` in all."""
    strata = rows.select(stratum).distinct().count()
    each = max(least_each, most // max(1, strata))
    spot = position(F.col(key))
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(spot, key))).where(F.col("__n") <= each).drop("__n")
    return ranked.orderBy(spot, key).limit(most)


def first_members(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("__n") <= n).drop("__n")


def display_picks(members: DataFrame, medoids: DataFrame, cluster: str, key: str, folio: str, n: int = 6) -> DataFrame:
    """(cluster, key, pick): the medoid of each cluster, then its first member from each folio, n in all.

    The medoid's own folio still gives its first member, which may be the medoid again.
    """
    first = members.withColumn("__f", F.row_number().over(Window.partitionBy(cluster, folio).orderBy(key))).where("__f = 1").select(cluster, key, F.lit(1).alias("__o"))
    every = medoids.select(cluster, key, F.lit(0).alias("__o")).unionByName(first)
    ranked = every.withColumn("pick", F.row_number().over(Window.partitionBy(cluster).orderBy("__o", key)) - 1)
    return ranked.where(F.col("pick") < n).select(cluster, key, "pick")
