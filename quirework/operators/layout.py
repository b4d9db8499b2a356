"""Words of a page: lines, places in lines, neighbours, and the records joined from all sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import geometry
from quirework.plans.workers import shipped

LINE_SCHEMA = "source_index int, line_index int"


class LineFold:
    """The line of each box of a page, given from top to bottom: box by box, holding no more than the present line's centres.

    A box joins the line whose present median centre is nearest, if it is within the limit; else it opens one. As boxes
    come from top to bottom, no median lies below them, so the nearest line is the lowest, the last one opened, and lines
    come in the order of their medians.
    """

    def __init__(self) -> None:
        self.page, self.line, self.run = None, -1, []

    def line_of(self, page: object, centre: float, limit: float) -> int:
        n = len(self.run)
        if page != self.page or self.line < 0:
            self.page, self.line, self.run = page, 0, [centre]
        elif centre - (self.run[n // 2] if n % 2 else (self.run[n // 2 - 1] + self.run[n // 2]) / 2) > limit:
            self.line, self.run = self.line + 1, [centre]
        else:
            self.run.append(centre)
        return self.line


def fold_lines(index: np.ndarray, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source_index, line_index) of the boxes of one page; the limit is 8, or 0.65 of the median height."""
    centres, fold = y + h / 2, LineFold()
    order = np.lexsort((index, x, centres))
    limit = max(8.0, 0.65 * float(np.median(h))) if len(h) else 8.0
    return index[order], np.array([fold.line_of("", c, limit) for c in centres[order].tolist()], np.int64)


def infer_lines(boxes: DataFrame, page: str = "folio") -> DataFrame:
    """boxes (page, source_index, x, y, w, h, ...) with line_index, token_index, line_length, line_start, line_end.

    Each box depends on those before, so a page's boxes pass through one task, in order, but none of them is held longer
    than its line is open. Boxes with a null number are left out. The places in lines are plain windows: by x, ties by
    centre, then source_index.
    """
    whole = boxes.where("source_index IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
    kind = dict(boxes.dtypes)[page]
    x, y, h = (F.col(c).cast("double") for c in "xyh")
    reach = F.greatest(F.lit(8.0), F.lit(0.65) * F.percentile(h, 0.5).over(Window.partitionBy(page)))
    ordered = shipped(whole).select(F.col(page).alias("page"), F.col("source_index").cast("int").alias("source_index"), (y + h / 2).alias("centre"), x.alias("x"), reach.alias("reach")).repartition("page").sortWithinPartitions("page", "centre", "x", "source_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = LineFold()
        for batch in batches:
            found = [fold.line_of(*row) for row in zip(batch["page"].tolist(), batch["centre"].tolist(), batch["reach"].tolist())]
            yield pd.DataFrame({"page": batch["page"], "source_index": batch["source_index"], "line_index": found})

    lines = ordered.mapInPandas(run, f"page {kind}, {LINE_SCHEMA}").withColumnRenamed("page", page)
    return places(whole.join(lines, [page, "source_index"]), [page, "line_index"], [F.col("x"), F.col("y") + F.col("h") / 2, F.col("source_index")])


def places(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Adds token_index, line_length, line_start and line_end, in the order within the group."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    length = F.count("*").over(Window.partitionBy(*group))
    numbered = rows.withColumn("token_index", at).withColumn("line_length", length.cast("int"))
    return numbered.withColumn("line_start", F.col("token_index") == 0).withColumn("line_end", F.col("token_index") == F.col("line_length") - 1)


def neighbours_in_line(words: DataFrame, group: list[str], order: list, label: str = "eva") -> DataFrame:
    """Adds prev_eva and next_eva: the labels before and after among the rows given (those that survived the filters)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return words.withColumn(f"prev_{label}", F.lag(label).over(w)).withColumn(f"next_{label}", F.lead(label).over(w))


def gap_sessions(rows: DataFrame, group: list[str], value: str, gap: float) -> DataFrame:
    """Adds session: numbers from 0, raised where value is more than gap above the one before. Not the rule of infer_lines."""
    w = Window.partitionBy(*group).orderBy(value)
    opened = (F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)) > gap).cast("int")
    return rows.withColumn("__o", opened).withColumn("session", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__o")


def word_records(boxes: DataFrame, labels: DataFrame, chosen: DataFrame, inventory: DataFrame, least_side: int = 8, least_area: int = 80) -> DataFrame:
    """The words of accepted pages, with boxes in the derivative and the full image, line and label context.

    boxes is (folio, source_index, word_index, x, y, w, h), labels (folio, word_index, eva), chosen the selected
    registrations, inventory (folio, site_class, ord). Labels that don't exist are null; the class of an unknown page is
    ''. Places in lines count all boxes, neighbours only words that are large enough.
    """
    lines = infer_lines(boxes)
    pages = chosen.where("accepted").select("folio", F.col("candidate_index").alias("canvas_index"), F.col("candidate_label").alias("canvas_label"), "homography_derivative", "homography_full", "target_width", "target_height", "canvas_width", "canvas_height")
    classes = inventory.where("folio IS NOT NULL").groupBy("folio").agg(F.max_by("site_class", "ord").alias("site_class"))
    rows = lines.join(pages, "folio").join(labels.select("folio", "word_index", "eva"), ["folio", "word_index"], "left").join(classes, "folio", "left")
    box = (F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    small = geometry.bounding_box(geometry.mapped_rect(F.col("homography_derivative"), *box))
    full = geometry.mapped_rect(F.col("homography_full"), *box)
    grow = F.greatest(F.lit(2), (5 * F.col("canvas_width") / F.col("target_width")).cast("int"))
    rows = rows.withColumn("d", small).withColumn("yale_polygon", full).withColumn("f", geometry.bounding_box(F.col("yale_polygon")))
    rows = rows.withColumn("derivative_xywh", geometry.clamped_box(F.col("d.x"), F.col("d.y"), F.col("d.w"), F.col("d.h"), F.col("target_width"), F.col("target_height"), 5))
    rows = rows.withColumn("yale_xywh", geometry.clamped_box(F.col("f.x"), F.col("f.y"), F.col("f.w"), F.col("f.h"), F.col("canvas_width"), F.col("canvas_height"), grow))
    d, f = F.col("derivative_xywh"), F.col("yale_xywh")
    kept = rows.where((d.w >= least_side) & (d.h >= least_side) & (d.w * d.h >= least_area) & (f.w >= 1) & (f.h >= 1))
    named = kept.withColumn("site_class", F.coalesce("site_class", F.lit("")))
    near = neighbours_in_line(named, ["folio", "line_index"], [F.col("token_index"), F.col("source_index")])
    return near.select("folio", "canvas_index", "canvas_label", "source_index", "word_index", "eva", F.array(*(c.cast("double") for c in box)).alias("source_rect"), "derivative_xywh", "yale_xywh", "yale_polygon", "site_class", "line_index", "token_index", "line_length", "line_start", "line_end", "prev_eva", "next_eva")
