"""An index of pivot permutations, for the most similar vectors of every vector.

A vector is represented by its nearest pivots, in order, and posted in the inverted file of each. Vectors posted under a
common pivot are candidates of each other; they may be ranked by the footrule distance of their permutations, and are
reranked by exact cosine. Nothing but the pivots, of which there are at most MOST_PIVOTS, goes to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.hashing import SPAN, position
from quirework.plans.lineage import cut
from quirework.plans.workers import shipped

MICRO = 1_000_000
MOST_PIVOTS = 8192
AT_ONCE = 4_000_000  # similarities that a Python worker holds at once, about
FULL = 2**15 - 1
SLACK = 4e-6  # more than single precision can be off
NARROW_SLACK = 3e-4  # more than 16-bit values can be off
MARK_BITS = 38


@dataclass(frozen=True)
class Index:
    """Settings of the index.

    pivots: per square root of the number of rows, so that lists and their number grow alike; posted: under how many
    pivots a vector is posted; reach: the least footrule similarity, posted * (posted + 1) / 2 minus half the footrule
    distance, of a candidate (1: every candidate in a common list is reranked); block: lists that are longer are cut,
    and all pairs of their blocks searched in tasks of their own; spread: no two pivots have this cosine or more, so
    that a dense group, however large, has one list that holds all of it instead of many that few near members share.
    """

    dim: int = 64
    pivots: float = 0.7
    posted: int = 4
    reach: int = 1
    block: int = 8192
    sample: int = 4  # rows drawn for each pivot wanted
    spread: float = 0.7
    narrow: bool = False  # post unit vectors of 16-bit values, half the size; cosines are then off by up to NARROW_SLACK


NEAREST_INDEX = Index(block=32_768)  # a list of many blocks is posted once for each of them


def usable_vectors(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of the rows with a key and dim finite values that aren't all zero; repeated rows still repeat."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("vec", lambda x: x != 0.0))


def one_vector_each(rows: DataFrame) -> DataFrame:
    """rows without the vectors of ids that come with several: the one of smallest hash counts.

    Repeated rows with one vector stay: they meet in the same lists and are dropped there, which spares a shuffle of all
    vectors. Only where ids with several vectors exist are the vectors shuffled.
    """
    return _chosen(rows, _hashes(rows))


def _hashes(rows: DataFrame) -> DataFrame:
    """(id, h, several): the smallest hash of each id's vectors, and whether there are others."""
    hashes = rows.select("id", F.xxhash64("vec").alias("h")).groupBy("id").agg(F.min("h").alias("h"), F.max("h").alias("h2"))
    return hashes.select("id", "h", (F.col("h") != F.col("h2")).alias("several"))


def _chosen(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    several = hashes.where("several")
    if several.isEmpty():
        return rows
    chosen = several.select(F.col("id").alias("i"), "h")
    return rows.join(chosen, rows["id"] == chosen["i"], "left").where(F.col("h").isNull() | (F.col("h") == F.xxhash64("vec"))).select("id", "vec")


def mark(column: str) -> Column:
    """A hash of an id of MARK_BITS bits, so that sums of many tell sets of ids apart."""
    return F.xxhash64(column).bitwiseAND(F.lit(2**MARK_BITS - 1))


@dataclass
class Prepared:
    """The rows to post (id, vec, weight, mark), the copies that need no posting (id, rep), if any, the number of ids, pivots, and blocks of hot lists.

    Of equal vectors the `copies` smallest ids are posted; the smallest of them (rep) stands for the rest: weight counts
    it and them, and mark is the sum of their marks. So a vector that a third of the rows share is posted a few times.
    """

    rows: DataFrame
    excess: DataFrame | None
    n: int
    pivots: np.ndarray
    blocks: dict[int, int]


def prepared(df: DataFrame, key: str, vec: str, index: Index, copies: int) -> Prepared:
    usable = usable_vectors(shipped(df), key, vec, index.dim)
    hashes = cut(_hashes(usable))
    rows = _chosen(usable, hashes)
    among = Window.partitionBy("h").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hot = hashes.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > copies).select("h")
    excess = None
    if not hot.isEmpty():
        ranked = hashes.join(hot, "h").withColumn("place", F.row_number().over(among)).withColumn("rep", F.min("id").over(among))
        excess = cut(ranked.where(F.col("place") > copies).select("id", "rep"))
        rest = excess.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("more"), F.sum(mark("id")).alias("marks"))
        rows = rows.join(excess.select("id"), "id", "left_anti").join(rest, "id", "left")
        rows = rows.select("id", "vec", (1 + F.coalesce("more", F.lit(0))).cast("bigint").alias("weight"), (mark("id") + F.coalesce("marks", F.lit(0))).alias("mark"))
    else:
        rows = rows.select("id", "vec", F.lit(1).cast("bigint").alias("weight"), mark("id").alias("mark"))
    n = hashes.count() - (excess.count() if excess is not None else 0)
    return Prepared(rows, excess, n, *choose_pivots(rows.select("id", "vec"), n, index))


def choose_pivots(rows: DataFrame, n: int, index: Index) -> tuple[np.ndarray, dict[int, int]]:
    """Pivots of unit length from a hash sample of the rows, and into how many blocks the lists of hot ones are cut.

    At most index.sample * MOST_PIVOTS rows come to the driver. How long a list gets is guessed from the sample; the
    guess decides how work is split, not what is found.
    """
    wanted = min(MOST_PIVOTS, max(16, math.ceil(index.pivots * math.sqrt(n))))
    rate = min(1.0, index.sample * wanted / max(n, 1))
    ordered = position("id", salt="pivot"), "id"
    drawn = rows.where(position("id", salt="pivot") < F.lit(int(rate * SPAN))).orderBy(*ordered).limit(index.sample * MOST_PIVOTS).toPandas()
    if rate < 1 and drawn["id"].nunique() < wanted:
        drawn = rows.orderBy(*ordered).limit(index.sample * wanted).toPandas()
    if drawn.empty:
        return np.zeros((0, index.dim), np.float32), {}
    unit = _unit(np.stack(drawn.drop_duplicates("id")["vec"].to_numpy()).astype(np.float32))
    _, first = np.unique(unit, axis=0, return_index=True)
    pivots = _apart(unit[np.sort(first)], index.spread, wanted)
    lists = np.bincount(_nearest(unit, pivots, index.posted).ravel(), minlength=len(pivots)) * (n / len(unit))
    return pivots, {int(p): math.ceil(1.25 * s / index.block) for p, s in enumerate(lists) if 1.25 * s > index.block}


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def _apart(unit: np.ndarray, spread: float, wanted: int) -> np.ndarray:
    """Up to `wanted` of the vectors, in order, each of a cosine under `spread` with those taken before."""
    taken, n = np.empty((min(wanted, len(unit)), unit.shape[1]), np.float32), 0
    for at in range(0, len(unit), 256):
        some = unit[at : at + 256]
        some = some[(some @ taken[:n].T).max(1, initial=-1.0) < spread]
        before = n
        for v in some:
            if n < len(taken) and (taken[before:n] @ v).max(initial=-1.0) < spread:
                taken[n] = v
                n += 1
    return taken[:n]


def _nearest(unit: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The places of the nearest pivots, nearest first, ties by place."""
    k, step = min(posted, len(pivots)), max(64, AT_ONCE // len(pivots))
    out = np.empty((len(unit), k), np.int32)
    for at in range(0, len(unit), step):
        sims = unit[at : at + step] @ pivots.T
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.lexsort((part, -np.take_along_axis(sims, part, 1)), axis=1)
        out[at : at + step] = np.take_along_axis(part, order, 1)
    return out


def post(rows: DataFrame, pivots: np.ndarray, blocks: dict[int, int], index: Index) -> DataFrame:
    """(list, one, two, own, id, data, perm, ...): every vector in the list of each of its nearest pivots; other columns of rows go along.

    A list that is cut into b blocks holds a vector in the b tasks (one <= two) that pair its block with another.
    """
    shared, dim, width = rows.sparkSession.sparkContext.broadcast(pivots), index.dim, 2 if index.narrow else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            x = np.ascontiguousarray(flat.reshape(-1, dim))
            perm = np.ascontiguousarray(_nearest(_unit(x), shared.value, index.posted))
            if index.narrow:
                x = np.rint(_unit(x) * np.float32(FULL)).astype(np.int16)
            data = pa.Array.from_buffers(pa.binary(width * dim), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
            marks = pa.Array.from_buffers(pa.binary(4 * perm.shape[1]), len(x), [None, pa.py_buffer(perm)]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(0, perm.size + 1, perm.shape[1], dtype=np.int32), perm.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), data, marks, lists, *batch.columns[2:]], names=["id", "data", "perm", "lists", *others])

    others = [c for c in rows.columns if c not in ("id", "vec")]
    kinds = dict(rows.dtypes)
    schema = "id bigint, data binary, perm binary, lists array<int>" + "".join(f", {c} {kinds[c]}" for c in others)
    posted = rows.select("id", "vec", *others).mapInArrow(run, schema).select("id", "data", "perm", *others, F.explode("lists").alias("list"))
    if not blocks:
        return posted.select("list", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("own"), "id", "data", "perm", *others)
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)), F.col("list")), F.lit(1))
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("one"), F.greatest(own, j).alias("two"), own.alias("own")))
    return posted.select("list", "id", "data", "perm", *others, F.explode(tasks).alias("t")).select("list", "t.one", "t.two", "t.own", "id", "data", "perm", *others)


class Block:
    """The vectors of one task, each id once, in order of id."""

    def __init__(self, pdf: pd.DataFrame, index: Index) -> None:
        ids = pdf["id"].to_numpy(np.int64)
        ids, first = np.unique(ids, return_index=True)
        self.ids, self.own = ids, pdf["own"].to_numpy()[first]
        raw = np.frombuffer(b"".join(pdf["data"].to_numpy()[first]), np.int16 if index.narrow else np.float32).reshape(len(ids), index.dim)
        self.wide = raw.astype(np.float64)
        self.wide /= np.sqrt((self.wide * self.wide).sum(1, keepdims=True))
        self.unit = self.wide.astype(np.float32)
        self.perm = np.frombuffer(b"".join(pdf["perm"].to_numpy()[first]), np.int32).reshape(len(ids), -1)
        _, same = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * index.dim))).ravel(), return_inverse=True)
        # the place of each vector among the equal ones, by id
        order = np.lexsort((np.arange(len(ids)), same.ravel()))
        run = same.ravel()[order]
        starts = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], np.arange(len(ids)), 0))
        self.copy = np.empty(len(ids), np.int64)
        self.copy[order] = np.arange(len(ids)) - starts


def footrule_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of permutation prefixes side by side: posted * (posted + 1) / 2 minus half the footrule distance, absent pivots last."""
    weight = a.shape[1] - np.arange(a.shape[1])
    same = a[:, :, None] == b[:, None, :]
    return (same * np.minimum(weight[:, None], weight[None, :])).sum((1, 2))


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest pivot in both prefixes."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(both, a, np.iinfo(np.int32).max).min(1)


def nearest_in(block: Block, rows: np.ndarray, cols: np.ndarray, k: int, least: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, micro-cosine) of the k nearest among cols of each of rows, as places in the block; ties to the smaller id.

    Of equal vectors only the k + 1 smallest ids can be among anyone's nearest.
    """
    cols = cols[block.copy[cols] <= k]
    out, step = [], min(1024, max(64, AT_ONCE // max(1, len(cols))))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        sims = block.unit[some] @ block.unit[cols].T
        sims[block.ids[some][:, None] == block.ids[cols][None, :]] = -2.0
        floor = np.full(len(some), least / MICRO - SLACK, np.float32)
        if len(cols) > k and reach <= 1:
            floor = np.maximum(floor, np.partition(sims, len(cols) - k, axis=1)[:, len(cols) - k] - np.float32(SLACK))
        i, j = np.nonzero(sims >= np.maximum(floor, -1.5)[:, None])
        i, j = some[i], cols[j]
        if reach > 1:
            near = footrule_similarity(block.perm[i], block.perm[j]) >= reach
            i, j = i[near], j[near]
        micro = np.rint(np.einsum("ij,ij->i", block.wide[i], block.wide[j]) * MICRO).astype(np.int32)
        good = micro >= least
        i, j, micro = i[good], j[good], micro[good]
        order = np.lexsort((j, -micro, i))
        i, j, micro = i[order], j[order], micro[order]
        starts = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
        best = np.arange(len(i)) - starts < k
        out.append((i[best], j[best], micro[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (rows[:0], rows[:0], rows[:0])


def in_task(block: Block, key: tuple, k: int, least: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_in for a task: a list or block with itself, or two blocks with each other."""
    _, one, two = key
    if one == two:
        every = np.arange(len(block.ids))
        return nearest_in(block, every, every, k, least, reach)
    a, b = np.flatnonzero(block.own == one), np.flatnonzero(block.own == two)
    return tuple(np.concatenate(x) for x in zip(nearest_in(block, a, b, k, least, reach), nearest_in(block, b, a, k, least, reach)))


def _searcher(k: int, least: int, index: Index) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf, index)
        i, j, micro = in_task(block, key, k, least, index.reach)
        # a pair that shares several lists is told by that of the smallest pivot: it is among the nearest there, too
        told = _first_shared(block.perm[i], block.perm[j]) == int(key[0])
        return pd.DataFrame({"id": block.ids[i[told]], "near": block.ids[j[told]], "micro": micro[told]})

    return run


def nearest(df: DataFrame, k: int = 5, least: float | None = None, key: str = "vec_id", vec: str = "vec", index: Index = NEAREST_INDEX) -> DataFrame:
    """(id, near, cosine, rank): up to k most similar other vectors of every usable vector, best first, ties to the smaller id.

    Vectors that are null, of another length, not finite or all zero have no rows and are no one's neighbours; each key
    counts once. Cosines are of double precision, rounded to 6 decimals; least leaves out those below it. The index is
    approximate: what shares no list is not found (the README has the recall). An empty table gives an empty one.
    """
    floor = -MICRO if least is None else round(least * MICRO)
    ready = prepared(df, key, vec, index, k + 1)
    empty = df.sparkSession.createDataFrame([], "id bigint, near bigint, cosine double, rank int")
    if not len(ready.pivots):
        return empty
    posted = post(ready.rows.select("id", "vec"), ready.pivots, ready.blocks, index)
    found = posted.groupBy("list", "one", "two").applyInPandas(_searcher(k, floor, index), "id bigint, near bigint, micro int")
    best = Window.partitionBy("id").orderBy(F.desc("micro"), "near")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if ready.excess is not None:
        # a copy beyond the k + 1 smallest has the nearest of the smallest, and that one
        ranked = cut(ranked)
        own = ready.excess.select("id", F.col("rep").alias("near"), F.lit(MICRO).alias("micro"))
        others = ready.excess.join(ranked.select(F.col("id").alias("rep"), "near", "micro"), "rep").select("id", "near", "micro")
        ranked = ranked.unionByName(own.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return ranked.select("id", "near", (F.col("micro") / F.lit(float(MICRO))).alias("cosine"), "rank")
