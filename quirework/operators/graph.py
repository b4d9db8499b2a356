"""The mutual graph and its components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.lineage import cut, cut_told, scratch
from quirework.plans.prefix import running_sum

RANGES = 256


def similarity_threshold(knn: DataFrame, floor: float, q: float) -> DataFrame:
    """One row (threshold): the q quantile of all similarities, but at least the floor; null without neighbours."""
    return knn.agg(F.percentile("sim", q).alias("q")).select(F.when(F.col("q").isNotNull(), F.greatest(F.lit(float(floor)), F.col("q"))).alias("threshold"))


def mutual_edges(knn: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i < j: pairs that are each among the other's neighbours, at least as similar as the threshold."""
    near = knn.where(F.col("sim") >= threshold).select("i", "j")
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return near.join(back, ["i", "j"], "left_semi").where("i < j").distinct()


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(id, component): every end with the smallest id it is linked with; smallest labels spread, and labels are shortened, until nothing changes."""
    with scratch(edges.sparkSession) as keep:
        return keep(_components(edges, a, b))


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    near = cut(ends.union(ends.select("b", "a")).distinct())
    state = cut(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        heard = near.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        spread = state.join(heard, state["id"] == heard["a"]).select("id", "label", F.least("label", "heard").alias("low"))
        short = state.select(F.col("id").alias("low"), F.col("label").alias("lower"))
        after, told = cut_told(spread.join(short, "low").select("id", F.least("low", "lower").alias("label"), (F.least("low", "lower") != F.col("label")).alias("moved")), F.count_if("moved").alias("moved"))
        state = after.select("id", "label")
        if not told["moved"]:
            return state.select("id", F.col("label").alias("component"))


def numbered_clusters(labels: DataFrame, least: int, most: int) -> DataFrame:
    """(id, component, size, cluster_id): components of a size within bounds, numbered from 0 by falling size, then smallest id; others are -1.

    Most components are of a few small sizes, so each size is cut into ranges of ids, which are numbered in tasks of their own.
    """
    sizes = cut(labels.groupBy("component").agg(F.count("*").alias("size")))
    valid = sizes.where(F.col("size").between(least, most))
    ends = valid.agg(F.min("component").alias("a"), F.max("component").alias("b")).first()
    width = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // RANGES + 1)
    place = F.floor((F.col("component") - F.lit(ends["a"] or 0)) / F.lit(width)).cast("bigint")
    valid = valid.withColumn("bucket", (F.lit(most) - F.col("size")) * F.lit(RANGES + 1) + place).withColumn("one", F.lit(1))
    valid = running_sum(valid, "one", "number", "bucket", ["component"]).withColumn("cluster_id", F.col("number") - 1)
    return labels.join(sizes, "component").join(valid.select("component", "cluster_id"), "component", "left").select("id", "component", "size", F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))


def centroids(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, size, centre): the mean vector of each group, of unit length."""
    spread = rows.where(F.col(vec).isNotNull()).select(group, F.posexplode(vec).alias("d", "x"))
    means = spread.groupBy(group, "d").agg(F.avg("x").alias("m"), F.count("*").alias("size"))
    length = F.greatest(F.sqrt(F.sum(F.pow("m", 2))), F.lit(1e-9))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"])
    return means.groupBy(group).agg(F.max("size").alias("size"), length.alias("l"), ordered.alias("c")).select(group, "size", F.transform("c", lambda x: x / F.col("l")).alias("centre"))
