"""The best N items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.folio import folio_form


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, with their rank.

    The filter on row_number lets the optimiser put a group limit before and after the shuffle, so a task sends at most
    n rows of a group, however many it has. Order should end in an identifier; rows alike in all of it are
    interchangeable. Null group keys form a group of their own; an empty table gives an empty one.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def usable() -> Column:
    """Registrations that count: null, NaN, infinite and impossible scores don't."""
    return (
        F.col("error").isNull()
        & (F.col("inliers") >= 0)
        & (F.col("inliers") <= F.col("matches"))
        & F.col("inlier_ratio").between(0.0, 1.0)
        & (F.col("median_reprojection_px") >= 0.0)
        & (F.col("median_reprojection_px") < float("inf"))
    )


def best_candidates(registrations: DataFrame, n: int = 3) -> DataFrame:
    """(folio, candidate_index, inliers, inlier_ratio, median_reprojection_px, rank): the n best candidates of a folio.

    Folios in folio form; rows that name no leaf, have no candidate_index or aren't usable don't count. A candidate run
    more than once counts by its best row. Ties go to the smaller candidate_index.
    """
    scores = [F.desc("inliers"), F.desc("inlier_ratio"), F.asc("median_reprojection_px")]
    rows = registrations.where(usable() & F.col("candidate_index").isNotNull()).select(
        folio_form(F.col("folio")).alias("folio"), "candidate_index", "inliers", "inlier_ratio", "median_reprojection_px"
    )
    once = top_n(rows.where(F.col("folio").isNotNull()), ["folio", "candidate_index"], scores, 1).drop("rank")
    return top_n(once, ["folio"], [*scores, F.asc("candidate_index")], n)
