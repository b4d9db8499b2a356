"""Boxes, quadrilaterals and homographies, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.workers import shipped


def cell(h: Column, row: int, col: int) -> Column:
    return h.getItem(row).getItem(col)


def mapped_point(h: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point under a homography; null where it goes to infinity."""
    depth = cell(h, 2, 0) * x + cell(h, 2, 1) * y + cell(h, 2, 2)
    depth = F.when(depth != 0, depth)
    return F.struct(((cell(h, 0, 0) * x + cell(h, 0, 1) * y + cell(h, 0, 2)) / depth).alias("x"), ((cell(h, 1, 0) * x + cell(h, 1, 1) * y + cell(h, 1, 2)) / depth).alias("y"))


def mapped_rect(h: Column, x: Column, y: Column, w: Column, hh: Column) -> Column:
    """The corners of a rectangle under a homography, clockwise from the upper left."""
    return F.array(mapped_point(h, x, y), mapped_point(h, x + w, y), mapped_point(h, x + w, y + hh), mapped_point(h, x, y + hh))


def bounding_box(points: Column) -> Column:
    """struct(x, y, w, h), whole numbers, around points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0 = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    return F.struct(x0.alias("x"), y0.alias("y"), (F.ceil(F.array_max(xs)) - x0).alias("w"), (F.ceil(F.array_max(ys)) - y0).alias("h"))


def clamped_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int | Column = 0) -> Column:
    """A box grown by pad and cut at the image's edges."""
    zero = F.lit(0)
    x0, y0 = F.greatest(zero, x - pad), F.greatest(zero, y - pad)
    x1, y1 = F.least(width, x + w + pad), F.least(height, y + h + pad)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(zero, x1 - x0).alias("w"), F.greatest(zero, y1 - y0).alias("h"))


def polygon_area(points: Column) -> Column:
    """The area within points (arrays [x, y]) in order, by the shoelace rule; 0 for fewer than three."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p[0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * p[1])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def scaled_homography(h: Column, sx: Column, sy: Column) -> Column:
    """diag(sx, sy, 1) times a homography."""
    by = F.array(sx, sy, F.lit(1.0))
    return F.transform(h, lambda row, i: F.transform(row, lambda v: v * by[i]))


def reprojection_error(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt(F.pow(x - u, 2) + F.pow(y - v, 2))


def overlap_shares(rows: DataFrame, points: str, width: str, height: str) -> DataFrame:
    """Adds overlap: the share of a convex polygon (arrays [x, y]) that lies within (0, 0, width, height); null without area.

    The polygon is cut by the four edges in turn, in Arrow batches: cutting has no end that a column expression could know.
    """

    @F.pandas_udf("double")
    def share(polygons: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([_share(p, w, h) for p, w, h in zip(polygons, widths, heights)], dtype="float64")

    return shipped(rows).withColumn("overlap", share(F.col(points), F.col(width).cast("double"), F.col(height).cast("double")))


def _area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def _share(polygon, width: float, height: float) -> float | None:
    points = [(float(p[0]), float(p[1])) for p in polygon] if polygon is not None else []
    whole = _area(points)
    if not whole > 0:
        return None
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        kept = []
        for p, q in zip(points, points[1:] + points[:1]):
            a, b = (p[axis] - limit) * sign, (q[axis] - limit) * sign
            if a >= 0:
                kept.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = kept
    return _area(points) / whole
