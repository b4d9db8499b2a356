"""Splits that keep related records together: components by concurrent searches, split in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.folio import folio_form, leaf_number
from quirework.functions.hashing import SPAN, position
from quirework.llm.components import hook_components
from quirework.llm.sampling import first_delivery
from quirework.plans.lineage import cut, cut_told, scratch
from quirework.plans.prefix import running_sum

SEED_RATES = (1 / 8, 1 / 2, 1.0)
BUCKETS, TABLES = 1024, 8


def frontier_components(edges: DataFrame, left: str, right: str, rates: tuple[float, ...] = SEED_RATES) -> DataFrame:
    """(id, group_id): every end of a link with the smallest id it is linked with, directly or not, itself included.

    The adjacency lists are partitioned by hash. A hash sample of the vertices is taken as seeds and all are expanded at
    once, a level at a time; a vertex keeps the label that reached it first (the smallest of a level). What no seed
    reached is seeded at the next rate, at last wholly. Edges between two labels are the collisions; they form a graph
    of seeds, whose components merge the labels. Nulls, loops, repeats and order of pairs make no difference.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_searched(edges, left, right, rates))


def _searched(edges: DataFrame, left: str, right: str, rates: tuple[float, ...]) -> DataFrame:
    rows = F.count("*").alias("rows")
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    near = cut(ends.union(ends.select("b", "a")).where("a <> b").distinct().repartition("a"))
    left_over = cut(ends.select("a").union(ends.select("b")).distinct())
    parts: list[DataFrame] = []  # what was reached, in written tables, put together when there are many

    def seen() -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if len(parts) > TABLES:
            parts[:] = [cut(whole)]
        return parts[0] if len(parts) == 1 else whole

    for wave, rate in enumerate(rates):
        spot = position("a", salt=f"seed{wave}")
        front, told = cut_told(left_over.where(spot < F.lit(int(rate * SPAN)) if rate < 1 else F.lit(True)).select("a", F.col("a").alias("seed")), rows)
        parts.append(front)
        while rate < 1 and told["rows"]:
            reached = front.join(near.hint("merge"), "a").groupBy("b").agg(F.min("seed").alias("seed")).select(F.col("b").alias("a"), "seed")
            front, told = cut_told(reached.join(seen(), "a", "left_anti"), rows)
            parts.append(front)
        if rate < 1:
            left_over = cut(left_over.join(seen(), "a", "left_anti"))
    reached_all = cut(seen())
    met = near.join(reached_all, "a").join(reached_all.select(F.col("a").alias("b"), F.col("seed").alias("other")), "b").where("seed < other").select("seed", "other").distinct()
    merged = hook_components(met, "seed", "other").select(F.col("id").alias("seed"), F.col("group_id").alias("end"))
    labels = reached_all.join(merged, "seed", "left").select("a", F.coalesce("end", "seed").alias("label"))
    least = labels.groupBy("label").agg(F.min("a").alias("group_id"))
    return labels.join(least, "label").select(F.col("a").alias("id"), "group_id")


def leaf_groups(folios: DataFrame, bifolios: DataFrame) -> DataFrame:
    """(folio, leaf, group_leaf) for each folio form of folios that names a leaf; group_leaf is the smallest leaf joined with it."""
    named = folios.select(folio_form(F.col("folio")).alias("folio")).where("folio IS NOT NULL").distinct().withColumn("leaf", leaf_number(F.col("folio"))).where("leaf IS NOT NULL")
    joined = frontier_components(bifolios, "leaf_a", "leaf_b").select(F.col("id").alias("leaf"), F.col("group_id").alias("group"))
    return named.join(joined, "leaf", "left").select("folio", "leaf", F.coalesce("group", "leaf").alias("group_leaf"))


def unit_splits(units: DataFrame, targets: list[tuple[str, float]], big: float = 0.02, salt: str = "split") -> DataFrame:
    """Adds split to units (unit, n): units lie on a line, by hash, each as long as its n; the targets cut the line.

    A unit goes where its middle lies. Units of more than `big` of all come first, largest first, and the largest split
    takes the start of the line, so that they don't fill a small split. Targets are taken in proportion to their sum;
    null, NaN and negative shares count as 0.
    """
    clean = sorted(((name, share) for name, share in targets if share is not None and share > 0), key=lambda t: (-t[1], t[0]))
    if not clean:
        raise ValueError("no split has a share")
    whole = sum(s for _, s in clean)
    total = units.agg(F.sum("n")).first()[0] or 0
    spot = position("unit", salt=salt)
    large = F.col("n") > F.lit(total * big)
    # there are at most 1 / big large units; bucket -1 holds them
    placed = units.withColumn("__spot", spot).withColumn("__bucket", F.when(large, F.lit(-1)).otherwise((F.col("__spot") / F.lit(SPAN // BUCKETS)).cast("int")))
    order: list[Column | str] = [F.when(large, -F.col("n")).otherwise(F.lit(0)), F.col("__spot"), F.col("unit")]
    along = running_sum(placed, "n", "__end", "__bucket", order)
    middle = (F.col("__end") - F.col("n") / 2) / F.lit(max(total, 1))
    split, upto = None, 0.0
    for name, share in clean[:-1]:
        upto += share / whole
        split = F.when(middle < upto, name) if split is None else split.when(middle < upto, name)
    split = F.lit(clean[0][0]) if split is None else split.otherwise(clean[-1][0])
    return along.withColumn("split_name", split).select(*units.columns, "split_name")


def split_targets(targets: DataFrame, most: int = 1000) -> list[tuple[str, float]]:
    """The targets as a list: a table of settings, of at most `most` rows."""
    rows = targets.where("split_name IS NOT NULL AND share IS NOT NULL AND NOT isnan(share)").groupBy("split_name").agg(F.max("share").alias("share")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} splits")
    return [(r["split_name"], float(r["share"])) for r in rows]


def proposal_splits(proposals: DataFrame, bifolios: DataFrame, targets: DataFrame) -> DataFrame:
    """(proposal_id, unit, split_name): each proposal once, all of one folio, leaf and joined leaves in one split.

    A proposal lies on the folio that its first delivery names. Folios that name no leaf are units by their trimmed,
    lower-case name; proposals without any folio are units of their own. Null proposal_ids don't count.
    """
    name = F.lower(F.trim(F.col("folio")))
    lies = first_delivery(proposals, "proposal_id", F.coalesce(folio_form(F.col("folio")), F.when(name != "", F.concat(F.lit("?"), name))), "ingested_at")
    groups = leaf_groups(proposals, bifolios).select(F.col("folio").alias("stratum"), "group_leaf")
    alone = F.when(F.col("stratum") == "", F.concat(F.lit("proposal:"), F.col("key"))).otherwise(F.concat(F.lit("name:"), "stratum"))
    keyed = cut(lies.join(groups, "stratum", "left").select(F.col("key").alias("proposal_id"), F.coalesce(F.concat(F.lit("leaf:"), "group_leaf"), alone).alias("unit")))
    units = unit_splits(keyed.groupBy("unit").agg(F.count("*").alias("n")), split_targets(targets))
    return keyed.join(units.select("unit", "split_name"), "unit").select("proposal_id", "unit", "split_name")
