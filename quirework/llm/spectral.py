"""Clusters of similar vectors: power-iteration spectral clustering of sparse affinities.

The index of pivot permutations is searched once for affinities. A few vectors are multiplied at once by the normalised
affinities; k-means in what results, each vector comparing only the centres that its own neighbours belong to, gives the
clusters. Whether they are closed is told by holding their pieces against all vectors (crossing.py). Nothing but pivots
goes to all tasks, and no cluster need fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.vectors import dot, norm
from quirework.llm.components import hook_components
from quirework.llm.crossing import across, pieces
from quirework.operators.pivots import AT_ONCE, MICRO, NARROW_SLACK, SLACK, Block, Index, one_vector_each, post, prepared, usable_vectors
from quirework.plans.lineage import cut, cut_told, scratch
from quirework.plans.workers import shipped

AFFINITY_INDEX = Index(posted=2, pivots=0.25, narrow=True)
ROUNDS, TOUCHING = 6, 0.3
# Coordinates are whole numbers of 1 / ONE, four in a long: a quarter of the shuffle, and sums that come out alike for every layout.
ONE, COORDINATES, LANE = 2**15 - 1, 4, 16
X = [f"x{i}" for i in range(COORDINATES)]
COPIES = 6  # of equal vectors, so many are posted; the smallest stands for the others


def _starts(run: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, run[1:] != run[:-1]])


def _search(index: Index, least: int, doubts: bool = False) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a list, or two blocks of one, gives.

    lo, hi and micro-cosine of each vector's nearest, of its similar one of smallest id, and of the smallest id that is
    surely similar; or instead, of the pairs that the stored precision leaves undecided.
    """
    slack = NARROW_SLACK if index.narrow else SLACK

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, (_, one, two) = Block(pdf, index), (int(v) for v in key)
        every = np.arange(len(block.ids))
        halves = [(every, every)] if one == two else [(np.flatnonzero(block.own == a), np.flatnonzero(block.own == b)) for a, b in ((one, two), (two, one))]
        links = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("lo", "hi", "micro")})]
        for rows, cols in halves:
            if not len(cols):
                continue
            step = max(64, min(2048, AT_ONCE // len(cols)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                sims = block.unit[some] @ block.unit[cols].T
                if one == two:
                    sims[np.arange(len(some)), at + np.arange(len(some))] = -2.0
                # few are similar, so all else is done with the pairs that are
                i, j = np.nonzero(sims >= np.float32(least / MICRO - (slack if doubts else 0)))
                value = sims[i, j]
                sure = value >= np.float32(least / MICRO + slack)
                if doubts:
                    told = [np.flatnonzero(~sure)]
                elif len(i):
                    starts, certain = _starts(i), np.flatnonzero(sure)
                    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(i)]))
                    top = np.flatnonzero(value == np.maximum.reduceat(value, starts)[run])
                    told = [starts, top[_starts(run[top])], certain[_starts(i[certain])] if len(certain) else certain]
                else:
                    told = []
                for chosen in told:
                    x, y = block.ids[some[i[chosen]]], block.ids[cols[j[chosen]]]
                    links.append(pd.DataFrame({"lo": np.minimum(x, y), "hi": np.maximum(x, y), "micro": np.rint(value[chosen] * MICRO).astype(np.int64)}))
        return pd.concat(links, ignore_index=True).drop_duplicates(["lo", "hi"])

    return run


@dataclass
class Affinities:
    """rows (id, vec) posted, of n ids; links (lo, hi, micro) of them; excess (id, rep), if any; doubts (lo, hi, micro), looked for only where they are asked for."""

    rows: DataFrame
    n: int
    links: DataFrame
    doubts: DataFrame
    excess: DataFrame | None

    def weighed(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the weight of the id in a column: itself and the copies that it stands for."""
        if self.excess is None:
            return rows.withColumn("weight", F.lit(1).cast("bigint"))
        rest = self.excess.groupBy(F.col("rep").alias(column)).agg(F.count("*").alias("__n"))
        return rows.join(rest, column, "left").withColumn("weight", 1 + F.coalesce("__n", F.lit(0))).drop("__n")


def affinities(df: DataFrame, least: float, key: str, vec: str, index: Index = AFFINITY_INDEX) -> Affinities | None:
    """All that the lists give; null where no vector is usable."""
    ready = prepared(df, key, vec, index, COPIES)
    if not len(ready.pivots):
        return None
    rows = ready.rows.select("id", "vec")
    tasks = post(rows, ready.pivots, ready.blocks, index).groupBy("list", "one", "two")
    found, doubts = (tasks.applyInPandas(_search(index, round(least * MICRO), d), "lo bigint, hi bigint, micro bigint").groupBy("lo", "hi").agg(F.max("micro").alias("micro")) for d in (False, True))
    return Affinities(rows, ready.n, cut(found), doubts, ready.excess)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{x}") - F.col(f"{b}.{x}"), 2) for x in X), F.lit(0.0)))


def _packed(values: list[Column]) -> Column:
    """Numbers up to ONE in one long; a walk's shares add up to 1, so sums of such longs don't run over."""
    return sum((F.shiftleft(v.cast("bigint"), LANE * i) for i, v in enumerate(values[1:], 1)), values[0].cast("bigint"))


def _lanes(column: str) -> list[Column]:
    return [F.shiftright(F.col(column), LANE * i).bitwiseAND(F.lit(2**LANE - 1)) for i in range(COORDINATES)]


@dataclass
class Embedded:
    """walk (src, dst, p, seed: that of dst), each source's rows in one partition, and points (id, seed, x0, x1, ...) likewise; both are kept by the executors."""

    walk: DataFrame
    points: DataFrame

    def release(self) -> None:
        self.walk.unpersist()
        self.points.unpersist()


def _kept(table: DataFrame, key: str) -> DataFrame:
    """table, partitioned and sorted by key and kept so, for joins that needn't move it; what is lost is made from its source again."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).persist()


def embedding(links: DataFrame, rounds: int = ROUNDS) -> Embedded:
    """Power iterations of the random walk over the links, each vector also linked to itself.

    They start from random values that a vector shares with those that have the same neighbour of smallest id (its
    seed), so that densely linked ones are nearly one point at once. A round moves the products only, added up before.
    """
    ends = F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))))
    both = _kept(links.select(ends.alias("e"), (F.col("micro") / F.lit(float(MICRO))).alias("w")).select("e.src", "e.dst", "w"), "dst")
    degree = cut(both.groupBy("dst").agg((1 + F.sum("w")).alias("degree"), F.least("dst", F.min("src")).alias("seed")))
    shares = both.join(both.groupBy("dst").agg((1 + F.sum("w")).alias("degree"), F.least("dst", F.min("src")).alias("seed")).hint("merge"), "dst")
    loops = degree.select(F.col("dst").alias("src"), "dst", (1 / F.col("degree")).alias("p"), "seed")
    walk = _kept(shares.select("src", "dst", (F.col("w") / F.col("degree")).alias("p"), "seed").unionByName(loops), "src")
    walk.count()
    both.unpersist()
    x = degree.select(F.col("dst").alias("id"), _packed([F.pmod(F.xxhash64("seed", F.lit(i)), F.lit(ONE)) for i in range(COORDINATES)]).alias("x"))
    for _ in range(rounds):
        shares = _packed([F.floor(F.col("p") * lane) for lane in _lanes("x")])
        x = walk.join(x.hint("merge"), walk["src"] == x["id"]).groupBy("dst").agg(F.sum(shares).alias("x")).withColumnRenamed("dst", "id")
    flat = [lane.alias(f"x{i}") for i, lane in enumerate(_lanes("x"))]
    points = cut(x.select("id", *flat).join(degree.select(F.col("dst").alias("id"), "seed"), "id"))
    return Embedded(walk, _kept(points, "id"))


def _centres(sums: DataFrame) -> DataFrame:
    """(label, x0, ...): the means of (label, n, x0, ...), in units of 1."""
    return sums.select("label", *((F.col(x) / F.col("n") / F.lit(float(ONE))).alias(x) for x in X))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in X)).where("n > 0")


def clusters(links: DataFrame, rounds: int = ROUNDS, touching: float = TOUCHING) -> DataFrame:
    """(id, label) of every linked vector.

    k-means in the embedding: the centres are at first the means of the points with one seed; linked centres nearer than
    `touching` are one centre. Then every point that has, or had, neighbours of other clusters goes to the nearest of
    their centres and its own, and the centres are the means of their points again, until no point moves. Centres are
    exact sums of whole numbers, so a round works only on the points at borders and on what the last round moved.
    """
    with scratch(links.sparkSession) as keep:
        space = embedding(links, rounds)
        try:
            return keep(_clusters(space, touching))
        finally:
            space.release()


def _clusters(space: Embedded, touching: float) -> DataFrame:
    walk, points = space.walk, space.points
    border = cut(points.join(walk.select(F.col("src").alias("id"), F.col("seed").alias("other")), "id").where("seed <> other").select("id", "seed", "other", *X).distinct())
    seeds = cut(_added(points.select(F.col("seed").alias("label"), F.lit(1).cast("bigint").alias("n"), *X)))
    a, b = _centres(seeds).alias("a"), _centres(seeds).alias("b")
    met = border.select(F.col("seed").alias("one"), F.col("other").alias("two")).distinct()
    close = met.join(a, F.col("one") == F.col("a.label")).join(b, F.col("two") == F.col("b.label")).where(_distance("a", "b") <= touching)
    merged = cut(hook_components(close, "one", "two").where("id <> group_id").select(F.col("id").alias("key"), F.col("group_id").alias("to")))

    def named(rows: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
        """rows with out: the column as names (key, to) have it now."""
        return rows.join(names.select(F.col("key").alias("__k"), F.col("to").alias("__to")), F.col(column) == F.col("__k"), "left").withColumn(out, F.coalesce("__to", column)).drop("__k", "__to")

    sums = cut(_added(named(seeds, "label", merged, "label")))
    asked = cut(named(named(border, "seed", merged, "label"), "other", merged, "other").where("label <> other").select("id", "label", "other", *X).distinct())
    moves = None
    while True:
        centres = _centres(sums)
        wide = asked.select("id", "label", "other", *((F.col(x) / F.lit(float(ONE))).alias(x) for x in X)).alias("p")
        own, other = centres.alias("own"), centres.alias("other")
        offers = wide.join(own, F.col("p.label") == F.col("own.label")).join(other, F.col("p.other") == F.col("other.label"))
        # by more than rounding can differ, so that no point goes to and fro
        better = offers.where(_distance("p", "other") < _distance("p", "own") - F.lit(1e-9)).groupBy("p.id", "p.label").agg(F.min(F.struct(_distance("p", "other").alias("d"), F.col("p.other").alias("to"))).alias("m"))
        moved, turn = cut_told(better.select("id", F.col("label").alias("was"), F.col("m.to").alias("to")), F.count("*").alias("n"))
        if not turn["n"]:
            break
        at = moved.join(asked.select("id", *X).distinct(), "id")
        one = F.lit(1).cast("bigint")
        sums = cut(_added(sums.unionByName(at.select(F.col("to").alias("label"), one.alias("n"), *X)).unionByName(at.select(F.col("was").alias("label"), (-one).alias("n"), *((-F.col(x)).alias(x) for x in X)))))
        fresh = moved.select(F.col("id").alias("key"), "to")
        moves = fresh if moves is None else cut(moves.join(fresh, "key", "left_anti").unionByName(fresh))
        # what moved is a neighbour of another cluster now, and has neighbours in the one it left
        heard = walk.join(moved.select(F.col("id").alias("src"), "to"), "src").select(F.col("dst").alias("id"), F.col("to").alias("other"))
        left = at.select("id", F.col("to").alias("label"), F.col("was").alias("other"), *X)
        heard = named(points.join(heard, "id"), "seed", merged, "label").select("id", "label", "other", *X)
        asked = cut(_relabelled(asked.unionByName(left).unionByName(heard), moves))
    whole = named(points.select("id", F.col("seed").alias("label")), "label", merged, "label")
    return _relabelled(whole, moves) if moves is not None else whole


def _relabelled(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows (id, label, ...), each once, with the labels to which moves (key, to) brought their ids."""
    now = rows.join(moves.select(F.col("key").alias("__k"), F.col("to").alias("__to")), F.col("id") == F.col("__k"), "left")
    return now.withColumn("label", F.coalesce("__to", "label")).drop("__k", "__to").distinct()


def _lowest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each cluster in a task: the least cosine of its members there."""
    out = []
    for label, part in pdf.groupby("label"):
        part = part.drop_duplicates("id").sort_values("id")
        x, own = np.stack(part["vec"].to_numpy()).astype(np.float64), part["own"].to_numpy()
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        rows, cols = x[own == key[1]], x[own == key[2]]
        out.append((int(label), min((int(np.rint(rows[at : at + 512] @ cols.T * MICRO).min(initial=MICRO)) for at in range(0, len(rows), 512)), default=MICRO)))
    return pd.DataFrame(out, columns=["label", "low"])


def _tasks(rows: DataFrame, block: int) -> DataFrame:
    """rows (label, id, size, ...) with task, one, two, own: small clusters share tasks of about `block` members; of a larger one each pair of its blocks has a task."""
    shares = F.lit(max(1, rows.count() // block + 1))
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    task = F.when(parts == 1, F.pmod(F.xxhash64("label"), shares)).otherwise(-1 - F.col("label"))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("one"), F.greatest(own, j).alias("two"), own.alias("own")))
    return rows.withColumn("task", task).withColumn("t", F.explode(pairs)).select(*rows.columns, "task", "t.one", "t.two", "t.own")


def _tight(members: DataFrame, least: float) -> DataFrame:
    """(label) of the clusters of members (label, id, size, cluster_key, vec) of which every two are of cosine `least` or more, in double precision."""
    # most clusters that aren't tight have a member unlike the smallest, which spares measuring them pair by pair
    wide = members.select("label", "id", "cluster_key", F.col("vec").cast("array<double>").alias("v_hi"))
    smallest = wide.where("id = cluster_key").select("label", F.col("v_hi").alias("v_lo"))
    loose = cut(wide.join(smallest, "label").where(~_similar(least)).select("label").distinct())
    rows = members.select("label", "id", "size", "vec").join(loose, "label", "left_anti")
    measured = _tasks(rows, Index.block).groupBy("task", "one", "two").applyInPandas(_lowest, "label bigint, low bigint")
    return measured.groupBy("label").agg(F.min("low").alias("low")).where(F.col("low") >= round(least * MICRO)).select("label")


def _similar(least: float) -> Column:
    """Whether v_lo and v_hi are of cosine `least` or more, to 6 decimals."""
    return F.round(dot(F.col("v_lo"), F.col("v_hi")) / (norm(F.col("v_lo")) * norm(F.col("v_hi"))), 6) >= least


def closed(labels: DataFrame, found: Affinities, least: float, index: Index = AFFINITY_INDEX, fewest: int = 5) -> DataFrame:
    """(id, cluster_key) of the groups of at least `fewest` of which every two are of cosine `least` or more, and none is of that with a vector outside.

    A closed group is all of what is linked to any of its members, so its parts in the labels (id, label) are pieces of
    which every two are similar. Every piece, single vectors too, is held against all others; those that are similar
    across are put together and, as what the stored precision leaves in doubt, measured pair by pair. So it are all groups
    there are, whatever the labels.
    """
    parts = pieces(found.rows, labels, found.n, least, index.dim)
    together = cut(hook_components(across(found.rows, parts, found.n, least), "piece", "other").withColumnRenamed("id", "piece"))
    asked = (F.col("unsure") | F.col("group_id").isNotNull()).alias("asked")
    members = parts.select("piece", "open", "unsure", F.explode("ids").alias("id")).join(together, "piece", "left").select("id", F.coalesce("group_id", "piece").alias("label"), "open", asked)
    sums = found.weighed(members, "id").groupBy("label").agg(F.some("open").alias("opened"), F.some("asked").alias("asked"), F.sum("weight").alias("heft"), F.count("*").alias("size"), F.min("id").alias("cluster_key"))
    groups = cut(sums.where((F.col("heft") >= fewest) & ~F.col("opened")).select("label", "size", "cluster_key", "asked"))
    doubtful = cut(members.select("id", "label").join(groups.where("asked").drop("asked"), "label"))
    tight = _tight(cut(found.rows.join(doubtful, "id")), least)
    whole = groups.where("NOT asked").select("label", "cluster_key").unionByName(groups.join(tight, "label").select("label", "cluster_key"))
    return members.select("id", "label").join(whole, "label").select("id", "cluster_key")


def _with_copies(rows: DataFrame, excess: DataFrame | None) -> DataFrame:
    """rows (id, ...), and those of the copies that weren't posted, as their representatives'."""
    if excess is None:
        return rows
    copies = excess.select("id", F.col("rep").alias("__rep")).join(rows.withColumnRenamed("id", "__rep"), "__rep").drop("__rep")
    return rows.unionByName(copies)


def closed_groups(df: DataFrame, least: float = 0.82, key: str = "vec_id", vec: str = "vec", fewest: int = 5) -> DataFrame:
    """(vec_id, cluster_key): members of the clusters of at least `fewest` of which every two are of cosine `least` or more and none is linked outside.

    The clusters are those of spectral clustering, then checked against all vectors, in double precision where 16-bit values
    can't tell; groups that it or the lists part are put together. Unusable vectors are in none; an empty table gives an empty one.
    """
    with scratch(df.sparkSession) as keep:
        found = affinities(df, least, key, vec)
        if found is None:
            return df.sparkSession.createDataFrame([], f"{key} bigint, cluster_key bigint")
        return keep(_with_copies(closed(clusters(found.links), found, least, fewest=fewest), found.excess)).withColumnRenamed("id", key)


def _summary(index: Index, typical: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Of each cluster in a task, or of the block of a larger one: the sum of its unit vectors, and its most typical members if it is whole here."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, part in pdf.groupby("label"):
            part = part.drop_duplicates("id").sort_values("id")
            x = np.stack(part["vec"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            total, ids = x.sum(0), part["id"].to_numpy(np.int64)
            best = np.lexsort((ids, -np.round(x @ total, 6)))[:typical]
            out.append((label, total.tolist(), ids[best].tolist() if len(ids) == part["size"].iloc[0] else None))
        return pd.DataFrame(out, columns=["label", "total", "typical"])

    return run


def described(df: DataFrame, least: float = 0.82, key: str = "vec_id", vec: str = "vec", folio: Column | None = None, fewest: int = 5, typical: int = 5, top: int = 5, block: int = Index.block) -> DataFrame:
    """(cluster_key, size, distinct_folios, top_folios, mean_centroid_cosine, typical) of all clusters of at least `fewest`.

    typical are the members of the largest sum of cosines with all members, to 6 decimals, ties to the smaller id;
    top_folios the folios with most members, ties by name. Small clusters share tasks; a larger one is cut into blocks of
    about `block` members, whose sums are added.
    """
    with scratch(df.sparkSession) as keep:
        return keep(_described(df, least, key, vec, folio, fewest, typical, top, block))


def _described(df: DataFrame, least: float, key: str, vec: str, folio: Column | None, fewest: int, typical: int, top: int, block: int) -> DataFrame:
    kind = "cluster_key bigint, size bigint, distinct_folios bigint, top_folios array<struct<folio: string, n: bigint>>, mean_centroid_cosine double, typical array<bigint>"
    found = affinities(df, least, key, vec)
    if found is None:
        return df.sparkSession.createDataFrame([], kind)
    labels = _with_copies(clusters(found.links), found.excess)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("cluster_key")).where(F.col("size") >= fewest)
    members = cut(labels.join(sizes, "label"))
    rows = one_vector_each(usable_vectors(shipped(df), key, vec, AFFINITY_INDEX.dim)).join(members.select("id", "label", "size"), "id")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    shares = F.lit(max(1, members.count() // block + 1))
    task = F.when(parts == 1, F.pmod(F.xxhash64("label"), shares)).otherwise(-1 - F.col("label"))
    tasks = rows.withColumn("task", task).withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    sums = cut(tasks.groupBy("task", "own").applyInPandas(_summary(AFFINITY_INDEX, typical), "label bigint, total array<double>, typical array<bigint>"))
    # larger clusters: their blocks' sums by dimension, then members against the whole
    added = sums.where("typical IS NULL").select("label", F.posexplode("total").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("x"))
    totals = cut(added.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total")))
    large = rows.join(totals, "label")
    wide = F.col("vec").cast("array<double>")
    strength = large.groupBy("label", "id").agg(F.max(F.round(dot(wide, F.col("total")) / norm(wide), 6)).alias("strength"))
    best = strength.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strength"), "id"))).where(F.col("n") <= typical)
    best = best.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("typical"))
    told = sums.where("typical IS NOT NULL").unionByName(totals.join(best, "label"))
    lies = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), (F.col("folio") if folio is None else folio).alias("folio")).groupBy("id").agg(F.min("folio").alias("folio"))
    counts = members.join(lies, "id").where("folio IS NOT NULL").groupBy("label", "folio").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "folio")))
    folios = ranked.groupBy("label").agg(F.count("*").alias("distinct_folios"), F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "folio", "n")))).alias("t"))
    folios = folios.select("label", "distinct_folios", F.transform("t", lambda s: F.struct(s["folio"].alias("folio"), s["n"].alias("n"))).alias("top_folios"))
    mean = F.round(norm(F.col("total")) / F.col("size"), 6)
    whole = sizes.join(told, "label").join(folios, "label", "left")
    return whole.select("cluster_key", "size", F.coalesce("distinct_folios", F.lit(0)).alias("distinct_folios"), "top_folios", mean.alias("mean_centroid_cosine"), "typical")
