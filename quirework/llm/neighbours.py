"""The most similar vectors of every vector, by the index of pivot permutations (operators/pivots.py).

A vector is represented by its nearest pivots, in order, and posted in the inverted file of each. Vectors posted under a
common pivot are candidates of each other; they may be ranked by the footrule distance of their permutations, and are
reranked by exact cosine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.pivots import Index, nearest, prepared

__all__ = ["Index", "found_pairs", "near_pairs", "nearest", "prepared"]


def near_pairs(near: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b): each pair of which one is among the nearest of the other, once."""
    return near.select(F.least("id", "near").alias("vec_id_a"), F.greatest("id", "near").alias("vec_id_b")).distinct()


def found_pairs(vectors: DataFrame, k: int = 5, least: float = 0.82, index: Index | None = None) -> DataFrame:
    """The pairs of the k nearest of cosine `least` or more; empty where no vector is usable."""
    return near_pairs(nearest(vectors, k, least, index=index) if index else nearest(vectors, k, least))
