"""Groups of records linked by pairs: deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.lineage import cut, cut_told, scratch


def _once(edges: DataFrame) -> DataFrame:
    """Undirected edges (lo, hi), each once, without loops and null ends."""
    return edges.where("lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()


def _at(table: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """table joined with names on key, by sorting both: names grow with the data, so they aren't broadcast."""
    return table.join(names.hint("merge"), key)


def _parents(edges: DataFrame) -> DataFrame:
    """(v, p): every vertex hooked to the far end of its smallest edge; of two that chose each other the smaller is root.

    Edges are ordered by a hash of their ends, then the ends: one order for all, so no longer cycles arise, and trees
    stay shallow even where the ids form chains.
    """
    weight = F.struct(F.xxhash64("lo", "hi").alias("h"), "lo", "hi")
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("v"), weight.alias("w"))
    far = F.when(F.col("v") == F.col("w.lo"), F.col("w.hi")).otherwise(F.col("w.lo"))
    hooks = ends.groupBy("v").agg(F.min("w").alias("w")).select("v", far.alias("p"))
    mutual = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
    return _at(hooks, "p", hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))).select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"))


def _doubled(parents: DataFrame) -> DataFrame:
    """(v, p, moved): every pointer doubled."""
    up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return _at(parents, "p", up).select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))


def hook_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, group_id): every end of a link with the smallest id it is linked with, directly or not, itself included.

    In a round every component takes its smallest outgoing edge, the trees collapse by pointer doubling, the edges are
    relabelled and deduplicated; components at least halve, so n vertices take at most log2(n) rounds. Nulls, loops,
    repeats and order of pairs make no difference; an empty table gives an empty one. Everything stays in tables; the
    driver only counts. State is cut off by checkpoints.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_hooked(edges, left, right))


def _hooked(edges: DataFrame, left: str, right: str) -> DataFrame:
    rows = F.count("*").alias("rows")
    links, told = cut_told(_once(edges.select(F.col(left).alias("lo"), F.col(right).alias("hi"))), rows)
    vertices, maps = links.select(F.explode(F.array("lo", "hi")).alias("id")).distinct(), []
    moved = F.count_if("moved").alias("moved")
    while told["rows"]:
        parents, turn = cut_told(_doubled(cut(_parents(links))), moved)
        while turn["moved"]:
            parents, turn = cut_told(_doubled(parents.drop("moved")), moved)
        maps.append(parents.drop("moved"))
        ends = _at(links, "lo", maps[-1].select(F.col("v").alias("lo"), F.col("p").alias("lo2"))).select(F.col("lo2").alias("lo"), "hi")
        links, told = cut_told(_once(_at(ends, "hi", maps[-1].select(F.col("v").alias("hi"), F.col("p").alias("hi2"))).select("lo", F.col("hi2").alias("hi"))), rows)
    if not maps:
        return vertices.select("id", F.col("id").alias("group_id"))
    # the maps shrink from round to round, so they are put together from the last to the first
    whole = maps.pop()
    while maps:
        after = whole.select(F.col("v").alias("p"), F.col("p").alias("end"))
        whole = cut(maps.pop().join(after.hint("merge"), "p", "left").select("v", F.coalesce("end", "p").alias("p")))
    return _at(whole, "p", whole.groupBy("p").agg(F.min("v").alias("group_id"))).select(F.col("v").alias("id"), "group_id")
