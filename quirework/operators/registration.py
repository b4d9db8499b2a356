"""Registrations of page images on canvases: candidates, gates, choice, second wave, adjudication and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import SCALE_RANGE, SCALES, Thresholds
from quirework.functions import geometry
from quirework.functions.text import leaf_base, leaf_tokens


def candidates(folios: DataFrame, canvases: DataFrame, broad: bool = False) -> DataFrame:
    """(folio, index): the canvases whose label names a folio's leaf.

    Where none does, or always if broad, also those that name the leaf before, itself or the next, on either side.
    Labels are taken apart into leaf tokens, so both are equi-joins. Folios that name no leaf have no candidates.
    """
    tokens = canvases.select("index", F.explode(leaf_tokens(F.col("label"))).alias("token"))
    keys = folios.select("folio", leaf_base(F.col("folio")).alias("k")).where("k IS NOT NULL").distinct()
    exact = keys.select("folio", F.col("k.base").alias("token")).join(tokens, "token").select("folio", "index").distinct()
    asked = keys if broad else keys.join(exact, "folio", "left_anti")
    around = F.array(*(F.concat((F.col("k.n") + d).cast("string"), F.lit(s)) for d in (-1, 0, 1) for s in "rv"))
    near = asked.select("folio", F.explode(around).alias("token")).join(tokens, "token").select("folio", "index")
    return exact.union(near).distinct()


def ratio_matches(near: DataFrame, ratio: float) -> DataFrame:
    """The best of each descriptor's two nearest (q, t, distance, rank), if clearly nearer than the second."""
    pairs = near.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.struct("t", "distance"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return pairs.where(F.col("first.distance") < ratio * F.col("second")).select("q", F.col("first.t").alias("t"), F.col("first.distance").alias("distance"))


def plausible(t: Thresholds = Thresholds()) -> Column:
    """Whether the image lies where it can: mostly on the canvas, of a fitting size, under finite numbers."""
    finite = ~F.exists(F.flatten("homography_derivative"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return at_least(F.col("intersection_ratio"), t.min_intersection) & F.col("target_area_ratio").between(*t.area_range) & finite


def at_least(value: Column, limit: float | Column) -> Column:
    """value >= limit, but false for NaN, which Spark takes for the largest number."""
    return ~F.isnan(value) & (value >= limit)


def accepted(t: Thresholds = Thresholds()) -> Column:
    """Whether a registration passes the gates; nulls and NaN don't."""
    ratio = at_least(F.col("inlier_ratio"), t.min_inlier_ratio)
    return F.coalesce(F.col("plausible_intersection") & (F.col("inliers") >= t.min_inliers) & ratio & (F.col("median_reprojection_px") <= t.max_median_px), F.lit(False))


def merit(*tie: Column) -> Column:
    """By which of two attempts is better: acceptance, inliers, their ratio, small error, then the ties' order. NaN is worst."""
    error, ratio = F.col("median_reprojection_px"), F.col("inlier_ratio")
    return F.struct(F.coalesce("accepted", F.lit(False)), F.coalesce("inliers", F.lit(-1)), F.when(F.isnan(ratio), -1.0).otherwise(F.coalesce(ratio, F.lit(-1.0))), -F.when(F.isnan(error), float("inf")).otherwise(F.coalesce(error, F.lit(float("inf")))), *tie)


def selected(attempts: DataFrame, key: str = "folio") -> DataFrame:
    """The best attempt for each folio: among the accepted, or else those without error; ties to the smaller candidate_index."""
    pool = attempts.where(F.coalesce(F.col("accepted"), F.lit(False)) | F.col("error").isNull()).where(F.col(key).isNotNull())
    best = pool.groupBy(key).agg(F.max_by(F.struct(*pool.columns), merit(-F.col("candidate_index"), -F.col("reg_id") if "reg_id" in pool.columns else F.lit(0))).alias("r"))
    return best.select("r.*")


def scales(width: Column) -> Column:
    """The widths at which an image is tried: the standard ones up to its own, and its own, none below the least."""
    least = SCALE_RANGE[0]
    every = F.concat(F.array(*(F.lit(s) for s in SCALES)), F.array(width))
    return F.array_sort(F.array_distinct(F.filter(every, lambda s: s.between(least, width))))


def best_scale(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The best attempt of all scales; ties to the larger width."""
    best = attempts.groupBy(*keys).agg(F.max_by(F.struct(*attempts.columns), merit(F.col("registration_scale_width"))).alias("r"))
    return best.select("r.*")


def register(folios: DataFrame, canvases: DataFrame, attempt: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All attempts, and the selected: exact candidates first, then all near ones of the folios that failed, but for those tried.

    attempt turns (folio, index) into registrations; matching images is its matter.
    """
    first = attempt(candidates(folios, canvases))
    chosen = selected(first).where("accepted").select("folio")
    failed = folios.select("folio").distinct().join(chosen, "folio", "left_anti")
    tried = first.select("folio", F.col("candidate_index").alias("index"))
    second = attempt(candidates(failed, canvases, broad=True).join(tried, ["folio", "index"], "left_anti"))
    every = first.unionByName(second, allowMissingColumns=True)
    return every, selected(every)


def accept_split(folios: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds accepted to folios; those without a registration are rejected."""
    return folios.join(chosen.select("folio", F.col("accepted").alias("__a")), "folio", "left").select(*[c for c in folios.columns], F.coalesce("__a", F.lit(False)).alias("accepted"))


def adjudicated(chosen: DataFrame, rules: DataFrame) -> DataFrame:
    """Registrations that rules accept although the gates don't.

    A rule (folio, candidate_index, candidate_label, min_inliers, min_ratio, max_median_px, evidence) holds for exactly that
    candidate, if its features support it and the evidence given with the rule does.
    """
    r = rules.select("folio", *(F.col(c).alias(f"__{c}") for c in rules.columns if c != "folio"))
    both = chosen.join(r, "folio", "left")
    fits = (F.col("candidate_index") == F.col("__candidate_index")) & (F.col("candidate_label") == F.col("__candidate_label"))
    holds = fits & (F.col("inliers") >= F.col("__min_inliers")) & at_least(F.col("inlier_ratio"), F.col("__min_ratio")) & (F.col("median_reprojection_px") <= F.col("__max_median_px")) & F.col("__evidence")
    gained = ~F.coalesce("accepted", F.lit(False)) & F.coalesce(holds, F.lit(False))
    basis = F.when(gained, "adjudicated").when(F.coalesce("accepted", F.lit(False)), "automatic")
    return both.select(*[F.col(c) for c in chosen.columns if c != "accepted"], (F.coalesce("accepted", F.lit(False)) | gained).alias("accepted"), basis.alias("acceptance_basis"))


def reprojection(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matches, inliers, inlier_ratio, median_reprojection_px, p95_reprojection_px) of matched points (keys, x1, y1, x2, y2, inlier) and their homography.

    The errors are those of the inliers; points that the homography sends to infinity have none.
    """
    p = geometry.mapped_point(F.col("homography_derivative"), F.col("x1"), F.col("y1"))
    error = F.when(F.col("inlier"), geometry.reprojection_error(F.col("p.x"), F.col("p.y"), F.col("x2"), F.col("y2")))
    seen = matches.withColumn("p", p).withColumn("error", error)
    inlier = F.col("inlier").cast("double")
    return seen.groupBy(*keys).agg(F.count("*").cast("int").alias("matches"), F.count_if("inlier").cast("int").alias("inliers"), F.avg(inlier).alias("inlier_ratio"), F.median("error").alias("median_reprojection_px"), F.percentile("error", 0.95).alias("p95_reprojection_px"))


def report(chosen: DataFrame) -> DataFrame:
    """One row of statistics over the accepted; null medians if there are none."""
    good = chosen.where("accepted")
    return good.agg(F.count("*").alias("accepted"), F.median("inliers").alias("median_inliers"), F.median("inlier_ratio").alias("median_ratio"), F.median("median_reprojection_px").alias("median_px"), F.percentile("p95_reprojection_px", 0.95).alias("p95_px"))
