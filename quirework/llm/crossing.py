"""Pieces of which vectors are similar across, without an index: every piece is held against every other.

A piece is a set of vectors within an angle of its centre, so two pieces whose centres are too far apart for any pair of
their vectors need no further look, nor do two of which all pairs together are similar on average. Of the others a vector
is held against the centre, and only what is left against the vectors themselves, in double precision. The bounds hold
for every vector, so no pair is missed. The vectors are moved to their pieces as 16-bit values; there is told, too, which
pieces are surely tight, and which surely aren't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.pivots import FULL, MICRO, NARROW_SLACK, _unit
from quirework.plans.lineage import cut

ANGLE_SLACK = 1e-3  # more than 16-bit values, single precision and rounding to 6 decimals can turn a vector or a limit
ROWS, COLUMNS = 1024, 4096  # centres held against each other at once
EXPANDED = 200_000  # vectors held against a centre at once, about
PART = 4096  # larger pieces are spread over the blocks, and looked at in parts
FEW, BLOCKS, MOST = 4000, 7, 250_000  # up to FEW vectors are one block; else there are BLOCKS, or more of MOST vectors


def stored(rows: DataFrame, dim: int) -> DataFrame:
    """(id, data) of rows (id, vec): unit vectors of 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
                x = np.rint(_unit(x) * np.float32(FULL)).astype(np.int16)
                data = pa.Array.from_buffers(pa.binary(2 * dim), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["id", "data"])

    return rows.select("id", "vec").mapInArrow(run, "id bigint, data binary")


def _wide(data: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.int16).reshape(len(data), -1).astype(np.float64)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _linked(near: np.ndarray) -> Iterator[np.ndarray]:
    """The places that are near to each other, directly or not, of each such set."""
    left = np.ones(len(near), bool)
    while left.any():
        part = np.zeros(len(near), bool)
        edge = part.copy()
        edge[left.argmax()] = True
        while edge.any():
            part |= edge
            edge = near[edge].any(0) & ~part
        left &= ~part
        yield np.flatnonzero(part)


def _told(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """pdf (id, label, data) with the pieces of its labels: what is surely similar within a label, directly or not.

    A piece of which two are surely not similar is open: it is part of no closed group, and each of its vectors is a piece
    of its own. It is unsure if the 16-bit values don't tell whether every two are similar.
    """
    pdf = pdf.drop_duplicates("id").sort_values(["label", "id"])
    x, label, piece = _wide(pdf["data"]).astype(np.float32), pdf["label"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64).copy()
    open_, unsure = np.zeros(len(x), bool), np.zeros(len(x), bool)
    high, low = np.float32(least + NARROW_SLACK), np.float32(least - NARROW_SLACK)
    starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    ends = np.r_[starts[1:], len(label)]
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        sims = x[a:b] @ x[a:b].T
        if sims.min() >= high:
            piece[a:b] = piece[a]
            continue
        for part in _linked(sims >= high):
            if len(part) > 1:
                lowest = sims[np.ix_(part, part)].min()
                open_[a + part], unsure[a + part] = lowest < low, low <= lowest < high
                if lowest >= low:
                    piece[a + part] = piece[a + part[0]]
    return pdf.assign(piece=piece, open=open_, unsure=unsure)


def _parts(at: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each piece in a block: its centre, the length of the mean of its unit vectors, the angle to the furthest of them, and these."""
    pdf = pdf.drop_duplicates("id").sort_values(["piece", "id"])
    x, piece = _wide(pdf["data"]), pdf["piece"].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    sizes = np.diff(np.r_[starts, len(piece)])
    centre = np.add.reduceat(x, starts, axis=0)
    length = np.sqrt((centre * centre).sum(1, keepdims=True))
    centre = np.where(length > 0, centre / np.maximum(length, 1e-300), x[starts])
    centre = np.rint(centre * FULL).astype(np.int16)
    wide = centre.astype(np.float64)
    wide /= np.sqrt((wide * wide).sum(1, keepdims=True))
    low = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(wide, sizes, 0)), starts)
    angle = np.where(sizes > 1, np.arccos(np.clip(low, -1.0, 1.0)) + ANGLE_SLACK, 0.0)
    raw, ids = pdf["data"].to_numpy(), pdf["id"].to_numpy(np.int64)
    ends = np.r_[starts, len(piece)]
    return pd.DataFrame({
        "at": at, "piece": piece[starts], "open": pdf["open"].to_numpy()[starts], "unsure": pdf["unsure"].to_numpy()[starts], "angle": angle, "mean": length[:, 0] / sizes, "centre": [c.tobytes() for c in centre],
        "ids": [ids[a:b] for a, b in zip(ends, ends[1:])], "data": [b"".join(raw[a:b]) for a, b in zip(ends, ends[1:])],
    })


def _near(least: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """(id, piece, other, sure): vectors of a block's pieces that may be similar to one of another piece; sure: the pieces hold similar ones, whichever."""
    limit = math.acos(least) + 3 * ANGLE_SLACK if least < 1 else 3 * ANGLE_SLACK

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left, right = (side.sort_values(["open", "angle"], kind="stable") for side in (left, right))
            a, b = (_wide(side["centre"]).astype(np.float32) for side in (left, right))
            (one, shut, wide, mean), (two, also, far, other) = ((s["piece"].to_numpy(np.int64), ~s["open"].to_numpy(bool), s["angle"].to_numpy(), s["mean"].to_numpy()) for s in (left, right))
            sizes = left["ids"].map(len).to_numpy()
            first, ids = np.r_[0, np.cumsum(sizes)[:-1]], np.concatenate(left["ids"].to_numpy())
            x = np.frombuffer(b"".join(left["data"]), np.int16).reshape(len(ids), -1)
            for p in range(0, len(a), ROWS):
                for q in range(0, len(b), COLUMNS):
                    rows, cols = slice(p, p + ROWS), slice(q, q + COLUMNS)
                    if not (shut[rows].any() or also[cols].any()):
                        continue
                    sims = a[rows] @ b[cols].T
                    i, j = np.nonzero(sims >= np.float32(math.cos(min(math.pi, wide[rows].max() + far[cols].max() + limit))))
                    value, i, j = sims[i, j], i + p, j + q
                    fits = (value >= np.cos(np.minimum(math.pi, wide[i] + far[j] + limit))) & (one[i] != two[j]) & (shut[i] | also[j])
                    value, i, j = value[fits], i[fits], j[fits]
                    # the mean of all their cosines, which the largest isn't below
                    sure = value * mean[i] * other[j] >= least + ANGLE_SLACK
                    out.append(pd.DataFrame({"id": ids[first[i[sure]]], "piece": one[i[sure]], "other": two[j[sure]], "sure": True}))
                    i, j = i[~sure], j[~sure]
                    # the vectors of i against the centre of j
                    total = np.cumsum(sizes[i])
                    for at in np.split(np.arange(len(i)), np.searchsorted(total, np.arange(EXPANDED, total[-1], EXPANDED)) if len(i) else []):
                        if not len(at):
                            continue
                        n = sizes[i[at]]
                        of = np.repeat(first[i[at]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        to = np.repeat(j[at], n)
                        y = x[of].astype(np.float32)
                        cosine = np.einsum("ij,ij->i", y, b[to]) / np.sqrt(np.einsum("ij,ij->i", y, y))
                        met = cosine >= np.cos(np.minimum(math.pi, far[to] + limit))
                        out.append(pd.DataFrame({"id": ids[of[met]], "piece": np.repeat(one[i[at]], n)[met], "other": two[to[met]], "sure": False}))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "piece", "other", "sure")}).astype({"sure": bool})

    return run


PARTS = "at int, piece bigint, open boolean, unsure boolean, angle double, mean double, centre binary, ids array<bigint>, data binary"


def _blocks(n: int) -> int:
    return 1 if n <= FEW else max(BLOCKS, math.ceil(n / MOST) | 1)


def pieces(rows: DataFrame, labels: DataFrame, n: int, least: float, dim: int) -> DataFrame:
    """The pieces of all rows (id, vec), which may repeat, of n ids: those of labels (id, label), see _told; a row without a label has its own.

    What has more than PART vectors is looked at in parts, which are pieces of their own.
    """
    large = cut(labels.groupBy("label").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")).where("parts > 1"))
    named = labels if large.isEmpty() else labels.join(large, "label", "left").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    part = F.coalesce("part", F.lit(0)) if "part" in named.columns else F.lit(0)
    label, blocks = F.coalesce("label", "id"), _blocks(n)
    placed = stored(rows, dim).join(named, "id", "left").select("id", label.alias("label"), part.cast("int").alias("part"), F.pmod(F.xxhash64(label, part), F.lit(blocks)).cast("int").alias("at"), "data")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _parts(int(key[0]), pd.concat([_told(some, least) for _, some in pdf.groupby("part")]))

    return cut(placed.groupBy("at").applyInPandas(run, PARTS))


def crossing(rows: DataFrame, members: DataFrame, n: int, least: float, dim: int) -> DataFrame:
    """across of rows (id, vec), which may repeat, and members (id, piece, open, size), n of them."""
    blocks = _blocks(n)
    spread = F.when(F.col("size") > PART, F.pmod(F.xxhash64("id"), F.lit(blocks))).otherwise(0)
    placed = stored(rows, dim).join(members, "id").select("id", "piece", "open", F.lit(False).alias("unsure"), F.pmod(F.xxhash64("piece", spread), F.lit(blocks)).cast("int").alias("at"), "data")
    return across(rows, cut(placed.groupBy("at").applyInPandas(lambda key, pdf: _parts(int(key[0]), pdf), PARTS)), n, least)


def across(rows: DataFrame, parts: DataFrame, n: int, least: float) -> DataFrame:
    """(piece, other): the pairs of pieces, not both open, that hold vectors of a cosine (to 6 decimals) of `least` or more to each other.

    All pairs of blocks of pieces meet, each in one task: the vectors of one block, and the centres alone of the other.
    """
    # of blocks in a ring, each meets itself and the half that follows
    blocks = _blocks(n)
    to = F.explode(F.array(*(F.pmod(F.col("at") - i, F.lit(blocks)).cast("int") for i in range(blocks // 2 + 1)))).alias("to")
    centres = parts.select(to, "piece", "open", "angle", "mean", "centre")
    near = cut(parts.groupBy("at").cogroup(centres.groupBy("to")).applyInPandas(_near(least), "id bigint, piece bigint, other bigint, sure boolean"))
    surely, near = near.where("sure").select("piece", "other"), near.where("NOT sure").drop("sure")
    pairs = near.count()
    if not pairs:
        return surely
    # every vector that takes is moved once, to tasks of some pieces or of a part of a larger one
    size = F.ceil(F.size("ids") / F.lit(PART)).cast("int")
    wanted = cut(parts.select(F.col("piece").alias("other"), "ids", size.alias("parts")).join(near.select("other").distinct(), "other"))
    theirs = wanted.select(F.explode("ids").alias("id"), "other", "parts").select("id", "other", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("other").alias("piece"))
    ours = near.join(wanted.select("other", "parts").distinct(), "other").select("id", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "piece")
    asked = cut(theirs.unionByName(ours).withColumn("task", F.pmod(F.xxhash64("other", "part"), F.lit(pairs // PART + 1))))
    needed = cut(asked.select("id").distinct())
    vectors = cut(rows.select("id", "vec").join(needed, "id").dropDuplicates(["id"]))
    return surely.unionByName(asked.join(vectors, "id").groupBy("task").applyInPandas(_met(round(least * MICRO)), "piece bigint, other bigint")).distinct()


def _met(least: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """(piece, other) of the vectors in a task that are similar to one of the other piece's there; those have it as their own."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (other, _), some in pdf.groupby(["other", "part"]):
            x = np.stack(some["vec"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            ours = some["piece"].to_numpy() != other
            a, b, piece = x[ours], x[~ours], some["piece"].to_numpy()[ours]
            for at in range(0, len(a), 512):
                met = np.rint((a[at : at + 512] @ b.T).max(1, initial=-1.0) * MICRO) >= least
                out += [(int(p), int(other)) for p in set(piece[at : at + 512][met])]
        return pd.DataFrame(out, columns=["piece", "other"], dtype=np.int64)

    return run
