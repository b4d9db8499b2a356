"""Settings that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that results depend on.
SEED = 408
SIMILARITY_FLOOR, SIMILARITY_QUANTILE, NEIGHBOURS = 0.82, 0.94, 11
CLUSTER_SIZES = (5, 2000)
MOST_DISCOVERED = 120_000
RATIO_TEST = 0.77
SCALES, SCALE_RANGE = (1000, 1200, 1400, 1600, 1800), (600, None)
SMOKE_FOLIOS = ("f1r", "f45r", "f57v", "f67r2", "f68v1")
INK_RANGE = (0.005, 0.92)
# The pairs of conjoint leaves, in the order of their numbers; leaf 12 has lost its other half.
LEAF_PAIRS = (
    (1, 8), (2, 7), (3, 6), (4, 5),
    (9, 16), (10, 15), (11, 14),
    (17, 24), (18, 23), (19, 22), (20, 21),
    (25, 32), (26, 31), (27, 30), (28, 29),
    (33, 40), (34, 39), (35, 38), (36, 37),
    (41, 48), (42, 47), (43, 46), (44, 45),
    (49, 56), (50, 55), (51, 54), (52, 53),
    (75, 84), (76, 83), (77, 82), (78, 81), (79, 80),
    (93, 96), (94, 95), (99, 102), (100, 101),
)


@dataclass(frozen=True)
class Thresholds:
    """When a registration is accepted."""

    min_inliers: int = 50
    min_inlier_ratio: float = 0.55
    max_median_px: float = 3.0
    min_intersection: float = 0.80
    area_range: tuple[float, float] = (0.005, 1.5)


@dataclass(frozen=True)
class ProposalLimits:
    """Which parts of a word are proposed; the second preset is the current one."""

    min_word: int = 8
    min_area: int = 8
    area_share: float = 0.002
    min_box_area: int = 24
    min_side: int = 2
    max_side_at_least: int = 5
    most_of_crop: float = 0.95
    components: int = 10
    by_ink: bool = True
    gap: float = 0.20
    merged: int = 6
    merged_area: int = 32
    window_min: int = 8
    window_step: float = 0.6
    window_step_min: int = 4
    window_step_rounds: bool = True
    windows: int = 4
    total: int | None = 18


BASE_LIMITS = ProposalLimits(min_word=3, min_area=5, area_share=0.0, min_box_area=0, max_side_at_least=2, components=16, by_ink=False, gap=0.18, merged=8, merged_area=0, window_min=6, window_step=0.5, window_step_min=3, window_step_rounds=False, windows=8, total=None)
CURRENT_LIMITS = ProposalLimits()


def leaf_pairs() -> list[tuple[int, int, int]]:
    """(pair, smaller leaf, larger leaf)."""
    return [(n, a, b) for n, (a, b) in enumerate(LEAF_PAIRS)]
