"""Registrations from image features: nearest descriptors of two images, a robust homography, the measures and the gates.

Finding features in images is the input's matter; from their descriptors on, everything is here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.config import RATIO_TEST, SEED, Thresholds
from quirework.functions import geometry
from quirework.operators.registration import accepted, plausible
from quirework.plans.workers import shipped

NEEDED = 4  # matches that fix a homography
MATCHED = "folio string, candidate_index int, x1 double, y1 double, x2 double, y2 double, distance double"
ESTIMATED = "folio string, candidate_index int, matches int, inliers int, inlier_ratio double, median_reprojection_px double, p95_reprojection_px double, homography_derivative array<array<double>>, error string"


def two_nearest(queries: np.ndarray, targets: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest target, its distance, the second's) of each query by Euclidean distance, ties to the earlier target; the second is infinite where there is none."""
    place, one, two = np.zeros(len(queries), np.int64), np.full(len(queries), np.inf), np.full(len(queries), np.inf)
    lengths = (targets * targets).sum(1)
    for at in range(0, len(queries) if len(targets) else 0, step):
        q = queries[at : at + step]
        off = np.maximum((q * q).sum(1)[:, None] - 2 * (q @ targets.T) + lengths[None, :], 0)
        here = np.arange(len(q))
        place[at : at + step] = best = off.argmin(1)
        one[at : at + step] = np.sqrt(off[here, best])
        off[here, best] = np.inf
        two[at : at + step] = np.sqrt(off.min(1))
    return place, one, two


def descriptor_matches(pairs: DataFrame, sources: DataFrame, targets: DataFrame, ratio: float = RATIO_TEST) -> DataFrame:
    """(folio, candidate_index, x1, y1, x2, y2, distance): descriptors of a folio's image whose nearest on the canvas is clearly nearer than the second.

    pairs is (folio, index), sources (folio, x, y, vec), targets (index, x, y, vec). A pair of images is one task's matter:
    images have some thousands of features, whatever the number of images.
    """
    asked = pairs.select("folio", F.col("index").cast("int").alias("candidate_index")).where("folio IS NOT NULL AND candidate_index IS NOT NULL").distinct()
    left = shipped(asked).join(sources.where("vec IS NOT NULL"), "folio").select("folio", "candidate_index", "x", "y", "vec")
    right = asked.join(targets.where("vec IS NOT NULL").withColumnRenamed("index", "candidate_index"), "candidate_index").select("folio", "candidate_index", "x", "y", "vec")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.sort_values(["x", "y"], kind="stable") for x in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: np.zeros(0, object if c.startswith("folio") else np.float64) for c in MATCHED.split(", ")})
        place, one, two = two_nearest(*(np.stack(x["vec"].to_numpy()).astype(np.float64) for x in (a, b)))
        good = one < ratio * two
        near = b.iloc[place[good]]
        return pd.DataFrame({"folio": np.full(int(good.sum()), key[0], object), "candidate_index": key[1], "x1": a["x"].to_numpy()[good], "y1": a["y"].to_numpy()[good], "x2": near["x"].to_numpy(), "y2": near["y"].to_numpy(), "distance": one[good]}).astype({"folio": object})

    keys, names = ("folio", "candidate_index"), ("folio", "candidate_index", "x", "y", "vec")
    return left.toDF(*names).groupBy(*keys).cogroup(right.toDF(*names).groupBy(*keys)).applyInPandas(run, MATCHED)


def fitted(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The homography from points p to q by least squares, points centred and scaled first; null where they don't fix one."""

    def even(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = points.mean(0)
        size = np.sqrt(2) / max(np.sqrt(((points - middle) ** 2).sum(1)).mean(), 1e-12)
        t = np.array([[size, 0, -size * middle[0]], [0, size, -size * middle[1]], [0, 0, 1]])
        return (points - middle) * size, t

    (a, ta), (b, tb) = even(p), even(q)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    plain = np.c_[a, one]
    rows = np.r_[np.c_[plain, zero, -b[:, :1] * plain], np.c_[zero, plain, -b[:, 1:] * plain]]
    try:
        _, s, v = np.linalg.svd(rows)
    except np.linalg.LinAlgError:
        return None
    if len(s) < 8 or s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def off_by(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    moved = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.sqrt((((moved[:, :2] / moved[:, 2:]) - q) ** 2).sum(1))
    return np.where(np.isfinite(off), off, np.inf)


def robust(p: np.ndarray, q: np.ndarray, px: float = 3.0, tries: int = 20_000, sure: float = 0.999, seed: int = SEED) -> tuple[np.ndarray, np.ndarray] | None:
    """(homography, inliers): of drawn fours of matches the one with most matches off by at most px, fitted again to these until they stay.

    Draws stop when a better one is unlikely (sure) to have been missed. They are seeded, so the answer is the same in every run.
    """
    if len(p) < NEEDED:
        return None
    rng, best, n, most = np.random.default_rng(seed), None, 0, tries
    while n < most:
        n += 1
        some = rng.choice(len(p), NEEDED, replace=False)
        h = fitted(p[some], q[some])
        if h is None:
            continue
        good = off_by(h, p, q) <= px
        if best is None or good.sum() > best.sum():
            best = good
            share = min(good.mean(), 1 - 1e-9) ** NEEDED
            most = min(tries, int(np.ceil(np.log(1 - sure) / np.log(1 - share))) if share > 1e-12 else tries)
    if best is None or best.sum() < NEEDED:
        return None
    h = None
    for _ in range(10):
        again = fitted(p[best], q[best])
        if again is None:
            break
        h, good = again, off_by(again, p, q) <= px
        if good.sum() < NEEDED or (good == best).all():
            break
        best = good
    return (h, off_by(h, p, q) <= px) if h is not None else None


def homographies(matches: DataFrame, pairs: DataFrame | None = None, px: float = 3.0) -> DataFrame:
    """One row for each (folio, candidate_index) of matches, and of pairs (folio, index) without any: counts, errors, homography, or an error."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x1", "y1", "x2", "y2"])
        p, q = pdf[["x1", "y1"]].to_numpy(np.float64), pdf[["x2", "y2"]].to_numpy(np.float64)
        row = {"folio": key[0], "candidate_index": key[1], "matches": len(pdf), "inliers": None, "inlier_ratio": None, "median_reprojection_px": None, "p95_reprojection_px": None, "homography_derivative": None}
        found = robust(p, q, px) if len(pdf) >= NEEDED else None
        if found is None:
            return pd.DataFrame([row | {"error": f"only {len(pdf)} ratio-test matches" if len(pdf) < NEEDED else "homography failure"}]).astype(object)
        h, good = found
        off = off_by(h, p, q)[good]
        return pd.DataFrame([row | {"inliers": int(good.sum()), "inlier_ratio": float(good.mean()), "median_reprojection_px": float(np.median(off)), "p95_reprojection_px": float(np.quantile(off, 0.95)), "homography_derivative": h.tolist(), "error": None}]).astype(object)

    found = shipped(matches).groupBy("folio", "candidate_index").applyInPandas(run, ESTIMATED)
    if pairs is None:
        return found
    none = pairs.select("folio", F.col("index").cast("int").alias("candidate_index")).distinct().join(found.select("folio", "candidate_index"), ["folio", "candidate_index"], "left_anti")
    return found.unionByName(none.withColumn("matches", F.lit(0)).withColumn("error", F.lit("only 0 ratio-test matches")), allowMissingColumns=True)


def registrations(estimated: DataFrame, folios: DataFrame, canvases: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Registrations of homographies(): quadrilaterals, shares, the homography in the full image, and the gates.

    folios is (folio, source_width, source_height), canvases (index, label, canvas_id, body_id, width, height, target_width,
    target_height): the sizes of the pictures that were matched, and of the full canvas.
    """
    canvas = canvases.select(F.col("index").cast("int").alias("candidate_index"), F.col("label").alias("candidate_label"), "canvas_id", "body_id", F.col("width").alias("canvas_width"), F.col("height").alias("canvas_height"), "target_width", "target_height")
    rows = estimated.join(canvas, "candidate_index").join(folios, "folio")
    h, w, hh = F.col("homography_derivative"), F.col("source_width").cast("double"), F.col("source_height").cast("double")

    def quad(by):
        return F.transform(geometry.mapped_rect(by, F.lit(0.0), F.lit(0.0), w, hh), lambda p: F.array(p["x"], p["y"]))

    rows = rows.withColumn("target_quad_derivative", F.when(h.isNotNull(), quad(h)))
    rows = rows.withColumn("homography_full", F.when(h.isNotNull(), geometry.scaled_homography(h, F.col("canvas_width") / F.col("target_width"), F.col("canvas_height") / F.col("target_height"))))
    rows = rows.withColumn("target_quad_full", F.when(h.isNotNull(), quad(F.col("homography_full"))))
    rows = geometry.overlap_shares(rows, "target_quad_derivative", "target_width", "target_height").withColumnRenamed("overlap", "intersection_ratio")
    area = F.when(h.isNotNull(), geometry.polygon_area(F.col("target_quad_derivative")))
    rows = rows.withColumn("target_area_ratio", area / F.greatest(F.lit(1), F.col("target_width") * F.col("target_height")))
    rows = rows.withColumn("plausible_intersection", F.coalesce(plausible(thresholds), F.lit(False)) & h.isNotNull())
    return rows.withColumn("accepted", accepted(thresholds) & F.col("error").isNull()).drop("source_width", "source_height")
