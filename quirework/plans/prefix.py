"""Running sums that need no single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, value: str, out: str, bucket: str, order: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """Adds the sum of value over all rows up to this one, in the order (bucket, *order), for each group of within.

    Buckets must follow the wanted order and should be many: each is sorted in a task of its own, and only their
    totals meet in one window. Null values count as 0. An empty table stays empty.
    """
    keys = [*(within or []), bucket]
    totals = df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("__inside", F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside)).join(offsets, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop("__inside", "__before", *(f"__k{i}" for i in range(len(keys))))
