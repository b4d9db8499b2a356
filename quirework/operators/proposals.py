"""Parts of words: components, merged neighbours and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import CURRENT_LIMITS, INK_RANGE, ProposalLimits

BOX = "struct<x:int,y:int,w:int,h:int>"


def window_boxes(width: Column, height: Column, limits: ProposalLimits = CURRENT_LIMITS) -> Column:
    """The windows over a word, full height, of 38 and 62 per cent of its width: evenly stepped, the last at the right edge."""

    def of(share: float) -> Column:
        w = F.greatest(F.lit(limits.window_min), F.least(width, F.rint(width * F.lit(share)).cast("int")))
        whole = F.rint if limits.window_step_rounds else F.floor
        step = F.greatest(F.lit(limits.window_step_min), whole(w * F.lit(limits.window_step)).cast("int"))
        last = F.greatest(F.lit(0), width - w)
        xs = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last))))
        return F.transform(F.slice(xs, 1, limits.windows), lambda x: F.struct(x.cast("int").alias("x"), F.lit(0).alias("y"), w.cast("int").alias("w"), height.cast("int").alias("h")))

    return F.concat(of(0.38), of(0.62))


def merged_boxes(components: Column, limits: ProposalLimits = CURRENT_LIMITS) -> Column:
    """Runs of components, from left to right, that lie close and overlap in height, as one box each; not those that are a component.

    A fold over the array: the running box grows while the next one is within the gap and overlaps a fifth of the lower
    height. Null or empty arrays give an empty one.
    """
    boxes = F.coalesce(components, F.array().cast(f"array<{BOX}>"))
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))), lambda b: b)
    heights = F.array_sort(F.transform(boxes, lambda b: b["h"].cast("double")))
    n = F.size(heights)
    middle = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    gap = F.greatest(F.lit(2), (middle * F.lit(limits.gap)).cast("int"))
    start = F.struct(F.array().cast(f"array<{BOX}>").alias("done"), F.lit(None).cast(BOX).alias("run"))

    def step(acc: Column, b: Column) -> Column:
        run = acc["run"]
        over = F.greatest(F.lit(0), F.least(run["y"] + run["h"], b["y"] + b["h"]) - F.greatest(run["y"], b["y"])) / F.greatest(F.lit(1), F.least(run["h"], b["h"]))
        joins = (b["x"] - (run["x"] + run["w"]) <= gap) & (over >= 0.20)
        x0, y0 = F.least(run["x"], b["x"]), F.least(run["y"], b["y"])
        grown = F.struct(x0.alias("x"), y0.alias("y"), (F.greatest(run["x"] + run["w"], b["x"] + b["w"]) - x0).alias("w"), (F.greatest(run["y"] + run["h"], b["y"] + b["h"]) - y0).alias("h"))
        done = F.when(run.isNull() | joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(run)))
        return F.struct(done.alias("done"), F.when(run.isNull(), b).when(joins, grown).otherwise(b).alias("run"))

    every = F.aggregate(ordered, start, step, lambda acc: F.when(acc["run"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))))
    fresh = F.filter(every, lambda b: ~F.array_contains(ordered, b))
    return F.slice(F.filter(fresh, lambda b: b["w"] * b["h"] >= limits.merged_area), 1, limits.merged)


def usable_components(components: Column, width: Column, height: Column, limits: ProposalLimits = CURRENT_LIMITS) -> Column:
    """Components (x, y, w, h, ink) that are neither specks nor the whole crop, in the order that the limits ask for; none of null."""
    area = width * height
    good = F.filter(F.coalesce(components, F.array().cast("array<struct<x:int,y:int,w:int,h:int,ink:int>>")), lambda c: (c["ink"] >= F.greatest(F.lit(limits.min_area), F.rint(area * F.lit(limits.area_share)))) & (c["w"] * c["h"] >= limits.min_box_area) & (F.least(c["w"], c["h"]) >= limits.min_side) & (F.greatest(c["w"], c["h"]) >= limits.max_side_at_least) & (c["w"] * c["h"] <= area * F.lit(limits.most_of_crop)))
    by_place = F.array_sort(F.transform(good, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"), c["ink"].alias("ink"))))
    if not limits.by_ink:
        return by_place
    ranked = F.array_sort(F.transform(good, lambda c: F.struct((-c["ink"]).alias("less"), c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"), c["ink"].alias("ink"))))
    best = F.slice(ranked, 1, limits.components)
    return F.array_sort(F.transform(best, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"), c["ink"].alias("ink"))))


def propose(words: DataFrame, keys: list[str], limits: ProposalLimits = CURRENT_LIMITS) -> DataFrame:
    """(keys, proposal_index, proposal_type, box): the parts of words (keys, width, height, components), each once, numbered.

    Components first, then merged ones, then windows; words that are too small have none. All inside the JVM.
    """
    large = words.where((F.col("width") >= limits.min_word) & (F.col("height") >= limits.min_word))
    parts = large.withColumn("__c", usable_components(F.col("components"), F.col("width"), F.col("height"), limits))
    as_box = F.transform("__c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h")))
    parts = parts.withColumn("__b", as_box)

    def typed(kind: str, boxes: Column) -> Column:
        return F.transform(boxes, lambda b: F.struct(F.lit(kind).alias("proposal_type"), b.alias("box")))

    every = F.array_distinct(F.concat(typed("component", F.slice("__b", 1, limits.components)), typed("merged_component", merged_boxes(F.col("__b"), limits)), typed("window", window_boxes(F.col("width"), F.col("height"), limits))))
    capped = every if limits.total is None else F.slice(every, 1, limits.total)
    return parts.select(*keys, F.posexplode(capped).alias("proposal_index", "p")).select(*keys, "proposal_index", "p.proposal_type", "p.box")


def keeps_ink(ink: Column) -> Column:
    return ink.between(*INK_RANGE)


def in_page(box: Column, derivative: Column, full: Column) -> tuple[Column, Column]:
    """A proposal's box in the derivative and in the full image: scaled by their ratio, rounded half to even, at least 1."""
    sx, sy = full["w"] / F.greatest(F.lit(1), derivative["w"]), full["h"] / F.greatest(F.lit(1), derivative["h"])
    one = F.lit(1)
    large = F.struct((full["x"] + F.rint(box["x"] * sx).cast("int")).alias("x"), (full["y"] + F.rint(box["y"] * sy).cast("int")).alias("y"), F.greatest(one, F.rint(box["w"] * sx).cast("int")).alias("w"), F.greatest(one, F.rint(box["h"] * sy).cast("int")).alias("h"))
    small = F.struct((derivative["x"] + box["x"]).alias("x"), (derivative["y"] + box["y"]).alias("y"), box["w"].alias("w"), box["h"].alias("h"))
    return small, large


def first_of_each(rows: DataFrame, keys: list[str], order: list, number: str) -> DataFrame:
    """The first row of each key, numbered anew from 0 within keys[0]."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return first.withColumn(number, F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)) - 1)
