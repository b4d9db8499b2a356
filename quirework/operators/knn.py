"""Nearest neighbours by cosine: exact in blocks, or by an index of pivot permutations where there are too many rows for that."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.pivots import Index, nearest
from quirework.plans.workers import shipped

BLOCK = 4096


def block_pairs(df: DataFrame, key: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(one, two, own, id, vec): every row once for each pair of blocks that its own is part of.

    Null keys and vectors and vectors with null values are left out. n rows make n / block tasks a row; each task holds
    two blocks, whatever n is.
    """
    rows = shipped(df).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    parts = F.lit(max(1, math.ceil(df.count() / block)))
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("one"), F.greatest(own, j).alias("two"), own.alias("own")))
    return rows.select("id", "vec", F.explode(tasks).alias("t")).select("t.one", "t.two", "t.own", "id", "vec")


def unit_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, own blocks and unit vectors of a task, in order of id, each id once."""
    once = pdf.drop_duplicates("id").sort_values("id")
    x = np.stack(once["vec"].to_numpy()).astype(np.float64)
    return once["id"].to_numpy(), once["own"].to_numpy(), x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def halves(own: np.ndarray, one: int, two: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What a task compares: a block with itself, or two blocks both ways."""
    if one == two:
        every = np.arange(len(own))
        return [(every, every)]
    a, b = np.flatnonzero(own == one), np.flatnonzero(own == two)
    return [(a, b), (b, a)]


def _nearest(k: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own, x = unit_rows(pdf)
        out = []
        for rows, cols in halves(own, *key):
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                sims = x[some] @ x[cols].T
                sims[ids[some][:, None] == ids[cols][None, :]] = -9.0
                floor = np.partition(sims, len(cols) - k, axis=1)[:, len(cols) - k] if len(cols) > k else np.full(len(some), -8.0)
                i, j = np.nonzero(sims >= np.maximum(floor, -8.0)[:, None])
                out.append(pd.DataFrame({"i": ids[some[i]], "j": ids[cols[j]], "sim": sims[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "sim": []})

    return run


def exact_knn(df: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 11, block: int = BLOCK) -> DataFrame:
    """(i, j, sim, rank): the k nearest others of each row by cosine, best first, ties to the smaller id.

    Each id counts once. An empty table gives an empty one; fewer than k others give all.
    """
    found = block_pairs(df, key, vec, block).groupBy("one", "two").applyInPandas(_nearest(k), "i bigint, j bigint, sim double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j")))
    return ranked.where(F.col("rank") <= k)


EXACT_UPTO = 5000
# many lists a row, as audits ask for a hundred neighbours that need not be alike
WIDE_INDEX = Index(posted=8, spread=0.9, block=32_768)


def nearest_rows(df: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 11, exact_upto: int = EXACT_UPTO, index: Index = WIDE_INDEX) -> DataFrame:
    """(i, j, sim, rank): exact_knn of up to exact_upto rows; of more, what the index finds, whose work doesn't grow with the rows squared.

    The index takes vectors of one length, that of the first; others, and those that aren't finite or all zero, have no
    neighbours there. Its cosines are rounded to 6 decimals.
    """
    usable = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    if usable.limit(exact_upto + 1).count() <= exact_upto:
        return exact_knn(df, key, vec, k)
    dim = usable.select(F.size(vec)).first()[0]
    found = nearest(df, k, None, key, vec, replace(index, dim=dim))
    return found.select(F.col("id").alias("i"), F.col("near").alias("j"), F.col("cosine").alias("sim"), "rank")


def pair_histogram(df: DataFrame, key: str, vec: str, label: str, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(score, same, different): how many pairs of rows of one label, and of two, have a cosine, rounded; null labels pair with none.

    No pair leaves its task: only counts do, at most one a value, of which there are 2 * 10 ** digits + 1.
    """
    named = df.where(F.col(label).isNotNull())
    ids = named.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(label).cast("string")).alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    rows = block_pairs(named, key, vec, block).join(ids, "id")

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf.drop_duplicates("id").sort_values("id")["label"].to_numpy()
        ids_, own, x = unit_rows(pdf)
        one, two = group
        a, b = (np.arange(len(ids_)),) * 2 if one == two else (np.flatnonzero(own == one), np.flatnonzero(own == two))
        score, alike = [], []
        for at in range(0, len(a), 1024):
            some = a[at : at + 1024]
            sims = np.rint((x[some] @ x[b].T) * 10**digits).astype(np.int64)
            keep = some[:, None] < b[None, :] if one == two else np.ones(sims.shape, bool)
            score.append(sims[keep])
            alike.append((names[some][:, None] == names[b][None, :])[keep])
        values, place = np.unique(np.concatenate(score), return_inverse=True)
        same = np.bincount(place, np.concatenate(alike), len(values)).astype(np.int64)
        return pd.DataFrame({"score": values, "same": same, "different": np.bincount(place, minlength=len(values)) - same})

    counted = rows.groupBy("one", "two").applyInPandas(run, "score bigint, same bigint, different bigint")
    return counted.groupBy("score").agg(F.sum("same").alias("same"), F.sum("different").alias("different"))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, key: str, vec: str, most: int = 4096) -> DataFrame:
    """(id, centroid, sim): the most similar of centroids (centroid, centre) for each row, ties to the smaller centroid.

    The centroids, at most `most`, are sent to all tasks; more are an error.
    """
    chosen = centroids.select("centroid", "centre").orderBy("centroid").limit(most + 1).collect()
    if len(chosen) > most:
        raise ValueError(f"more than {most} centroids")
    names = np.array([c["centroid"] for c in chosen])
    centres = np.array([c["centre"] for c in chosen], np.float64).reshape(len(chosen), -1)
    shared = rows.sparkSession.sparkContext.broadcast((names, centres / np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-9)))

    def run(batches):
        names_, unit = shared.value
        for batch in batches:
            if not len(batch) or not len(names_):
                continue
            x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            sims = (x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)) @ unit.T
            best = sims.argmax(1)
            yield pd.DataFrame({"id": batch["id"], "centroid": names_[best], "sim": sims[np.arange(len(best)), best]})

    ready = shipped(rows).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    return ready.mapInPandas(run, "id bigint, centroid bigint, sim double")
