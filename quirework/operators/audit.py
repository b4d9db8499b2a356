"""The audits: words, clusters, held-out leaves, variants, leakage, stability, and the gate over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import CLUSTER_SIZES, MOST_DISCOVERED, NEIGHBOURS, SEED, SIMILARITY_FLOOR, SIMILARITY_QUANTILE
from quirework.functions.hashing import position
from quirework.functions.vectors import dot, norm
from quirework.operators import graph, stats
from quirework.operators.knn import EXACT_UPTO, nearest_centroid, nearest_rows, pair_histogram
from quirework.operators.sampling import first_byte, stratified_cap
from quirework.plans.lineage import cut
from quirework.plans.workers import shipped


def word_audit(rows: DataFrame, key: str, vec: str, label: str, group: str, k: int = 99) -> DataFrame:
    """One row (n, exact_label_nn, nearest_same_group, queries, hit_at_1, mrr, auc) of labelled vectors in groups.

    Up to EXACT_UPTO rows the neighbours are exact and the AUC is over all pairs; beyond, the neighbours are those of the
    index and the AUC is over 100,000 drawn pairs.
    """
    knn = cut(nearest_rows(rows, key, vec, k))
    labels = cut(rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(group).alias("grp")).where("id IS NOT NULL"))
    a, b = labels.alias("a"), labels.alias("b")
    nearest = knn.where("rank = 1").join(a, F.col("i") == F.col("a.id")).join(b, F.col("j") == F.col("b.id"))
    one = nearest.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("a.label") == F.col("b.label"), F.lit(False)).cast("double")).alias("exact_label_nn"), F.avg(F.col("a.grp").eqNullSafe(F.col("b.grp")).cast("double")).alias("nearest_same_group"))
    few = rows.limit(EXACT_UPTO + 1).count() <= EXACT_UPTO
    area = (stats.auc_of_histogram(pair_histogram(rows, key, vec, label)) if few else drawn_auc(rows, key, vec, label)).select("auc")
    return one.join(F.broadcast(stats.retrieval(knn, labels)), how="full").join(F.broadcast(area), how="full")  # one row each


def drawn_auc(rows: DataFrame, key: str, vec: str, label: str, n: int = 50_000) -> DataFrame:
    """One row (auc, positives, negatives) over n drawn pairs of each kind, labels drawn before members."""
    pairs = stats.sampled_pairs(rows, key, label, n)
    sides = {c: rows.where(F.col(vec).isNotNull()).groupBy(F.col(key).alias(c)).agg(F.min(vec).alias(f"v{c}")) for c in "ab"}
    cosine = dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb")))
    return stats.auc(pairs.join(sides["a"], "a").join(sides["b"], "b").select("same", F.round(cosine, 6).alias("score")), "score", "same")


def discovered(rows: DataFrame, key: str, vec: str, k: int = NEIGHBOURS, floor: float = SIMILARITY_FLOOR, q: float = SIMILARITY_QUANTILE, sizes: tuple[int, int] = CLUSTER_SIZES, folio: str | None = None, most: int = MOST_DISCOVERED) -> tuple[DataFrame, DataFrame, float]:
    """(id, component, size, cluster_id) of the vectors with a mutual edge, the edges and the threshold.

    Of more than `most` vectors a sample stratified by folio is taken, where folio is given: a limit of the audit's own.
    """
    if folio is not None and rows.limit(most + 1).count() > most:
        rows = cut(stratified_cap(rows.where(F.col(key).isNotNull()), folio, key, most))
    knn = cut(nearest_rows(rows, key, vec, k))
    threshold = graph.similarity_threshold(knn, floor, q).first()["threshold"]
    edges = cut(graph.mutual_edges(knn, threshold if threshold is not None else floor))
    return graph.numbered_clusters(graph.components(edges), *sizes), edges, threshold


def cluster_report(rows: DataFrame, clusters: DataFrame, key: str, vec: str, folio: Column, kind: Column) -> DataFrame:
    """(cluster_id, size, distinct_folios, top_folios, proposal_types, mean_centroid_cosine, p05_centroid_cosine, medoid) of numbered clusters.

    The medoid is the member nearest to the centre; similarities alike to nine digits tie, and the smallest id wins.
    """
    members = cut(rows.select(F.col(key).alias("id"), F.col(vec).alias("vec"), folio.alias("folio"), kind.alias("kind")).join(clusters.where("cluster_id >= 0").select("id", "cluster_id"), "id"))
    centres = graph.centroids(members, "cluster_id", "vec").select("cluster_id", "centre")
    unit = F.sqrt(dot(F.col("vec"), F.col("vec")))
    scored = members.join(centres, "cluster_id").withColumn("sim", dot(F.col("vec"), F.col("centre")) / unit)
    main = scored.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("folio").alias("distinct_folios"), F.avg("sim").alias("mean_centroid_cosine"), F.percentile("sim", 0.05).alias("p05_centroid_cosine"), F.max_by("id", F.struct(F.round("sim", 9), -F.col("id"))).alias("medoid"))
    counts = members.where("folio IS NOT NULL").groupBy("cluster_id", "folio").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "folio"))).where("k <= 5")
    folios = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "folio", "n"))), lambda s: F.struct(s["folio"].alias("folio"), s["n"].alias("n"))).alias("top_folios"))
    kinds = members.where("kind IS NOT NULL").groupBy("cluster_id", "kind").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("proposal_types"))
    return main.join(folios, "cluster_id", "left").join(kinds, "cluster_id", "left")


def held_out(pair: Column, below: int = 52) -> Column:
    """Whether a pair of leaves is held out: the first byte of its seeded hash; null for no pair."""
    return F.when(pair.isNotNull(), first_byte(pair) < below)


def recurrence(rows: DataFrame, cluster: str, folio: str, held: str, accepted: str) -> DataFrame:
    """One row (eligible, recurrent, fraction): clusters of 10 training rows on 3 folios, and those found again, 3 times on 2 folios."""
    train, test = ~F.col(held), F.col(held) & F.col(accepted)
    counts = rows.groupBy(cluster).agg(F.count_if(train).alias("train_n"), F.count_distinct(F.when(train, F.col(folio))).alias("train_folios"), F.count_if(test).alias("held_n"), F.count_distinct(F.when(test, F.col(folio))).alias("held_folios"))
    fit = (F.col("train_n") >= 10) & (F.col("train_folios") >= 3)
    again = fit & (F.col("held_n") >= 3) & (F.col("held_folios") >= 2)
    return counts.agg(F.count_if(fit).alias("eligible"), F.count_if(again).alias("recurrent"), (F.count_if(again) / F.greatest(F.lit(1), F.count_if(fit))).alias("fraction"))


def holdout_test(rows: DataFrame, key: str, vec: str, folio: str, pair: Column, least: tuple[int, int, int] = (100, 100, 30), sample: int = 50_000) -> DataFrame:
    """One row (status, train_n, held_n, k, accept_rate, eligible, recurrent, fraction): k-means on training pairs, held-out rows by nearest centre.

    A held-out row is accepted if it is as near to its centre as all but a twentieth of the centre's training rows. The
    centres are fitted on a hash sample of at most `sample` training rows; all rows are assigned and judged.
    """
    ready = cut(rows.where(pair.isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.col(folio).alias("folio"), held_out(pair).alias("held")))
    train, test = ready.where("NOT held"), ready.where("held")
    n, m = train.count(), test.count()
    status = "insufficient" if n + m < least[0] else "split_too_small" if n < least[1] or m < least[2] else "ok"
    if status != "ok":
        return rows.sparkSession.createDataFrame([(status, n, m, None, None, None, None, None)], "status string, train_n bigint, held_n bigint, k bigint, accept_rate double, eligible bigint, recurrent bigint, fraction double")
    k = min(128, max(16, math.isqrt(n // 2)))
    centres = sample_centres(train.withColumn("g", F.lit(0)), "g", "id", "vec", k, sample).select(F.col("side").cast("bigint").alias("centroid"), "centre")
    assigned = cut(nearest_centroid(ready, centres, "id", "vec").join(ready.select("id", "folio", "held"), "id"))
    limits = assigned.where("NOT held").groupBy("centroid").agg(F.percentile("sim", 0.05).alias("limit"))
    judged = assigned.join(limits, "centroid", "left").withColumn("accepted", F.col("sim") >= F.coalesce("limit", F.lit(1.0)))
    rate = judged.where("held").agg(F.avg(F.col("accepted").cast("double")).alias("accept_rate"))
    first = F.lit(status).alias("status"), F.lit(n).cast("bigint").alias("train_n"), F.lit(m).cast("bigint").alias("held_n"), F.lit(k).cast("bigint").alias("k")
    return rate.join(F.broadcast(recurrence(judged, "centroid", "folio", "held", "accepted")), how="full").select(*first, "accept_rate", "eligible", "recurrent", "fraction")


def balanced_folds(groups: list[tuple[str, int]], folds: int) -> list[tuple[str, int]]:
    """(group, fold): groups of a number of rows in folds of about equal numbers, at most as many as there are groups."""
    sizes = [0] * max(1, min(folds, len(groups)))
    out = []
    for group, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        fold = min(range(len(sizes)), key=lambda f: (sizes[f], f))
        sizes[fold] += n
        out.append((group, fold))
    return out


def leakage(rows: DataFrame, vec: str, label: str, group: str, least_class: int = 50, least: int = 200, most: int = 12_000, folds: int = 5, iterations: int = 400) -> DataFrame:
    """One row (status, n, classes, accuracy_mean, accuracy_sd, majority): how well the label is told from the vector, over folds of whole groups.

    Of more than `most` rows a hash sample is taken. Groups go, largest first, to the fold with fewest rows.
    """
    sized = rows.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "") & F.col(vec).isNotNull())
    kept = sized.groupBy(label).agg(F.count("*").alias("c")).where(F.col("c") >= least_class).select(label)
    ready = sized.join(kept, label, "left_semi").orderBy(F.xxhash64(F.col(group).cast("string"), F.col(vec).cast("string"))).limit(most)
    ready = cut(ready.select(F.col(label).cast("string").alias("y"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(vec).cast("array<double>").alias("vec")))
    n, classes = ready.count(), ready.select("y").distinct().count()
    if n < least or classes < 2:
        return rows.sparkSession.createDataFrame([("insufficient", n, classes, None, None, None)], "status string, n bigint, classes bigint, accuracy_mean double, accuracy_sd double, majority double")
    placed = balanced_folds([(r["grp"], r["count"]) for r in ready.groupBy("grp").count().collect()], folds)  # at most `most` groups
    ready = ready.join(F.broadcast(rows.sparkSession.createDataFrame(placed, "grp string, fold int")), "grp")
    indexed = cut(StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(ready).transform(ready).select("label", "fold", "vec"))
    featured = indexed.select("label", "fold", array_to_vector("vec").alias("features"))
    scores = []
    for fold in range(folds):
        train, test = featured.where(F.col("fold") != fold), featured.where(F.col("fold") == fold)
        size = train.count()
        if size and not test.isEmpty():
            model = LogisticRegression(maxIter=iterations, tol=1e-4, regParam=1 / (0.5 * size), standardization=False).fit(train)
            scores.append(model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    found = rows.sparkSession.createDataFrame([(s,) for s in scores], "score double")
    majority = indexed.groupBy("label").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("majority"))
    spread = found.agg(F.avg("score").alias("accuracy_mean"), F.stddev_pop("score").alias("accuracy_sd"))
    return spread.join(F.broadcast(majority), how="full").select(F.lit("ok").alias("status"), F.lit(n).cast("bigint").alias("n"), F.lit(classes).cast("bigint").alias("classes"), "accuracy_mean", "accuracy_sd", "majority")


def lloyd(x: np.ndarray, k: int, starts: int, rng: np.random.Generator, rounds: int = 200) -> np.ndarray:
    """The k centres of the best of some runs of k-means on x, from starts that lie apart; fewer rows than k give as many centres."""
    k, best = min(k, len(x)), (np.inf, x[:0])
    lengths = (x * x).sum(1)
    for _ in range(starts):
        centres = np.empty((k, x.shape[1]))
        centres[0] = x[rng.integers(len(x))]
        far = np.full(len(x), np.inf)
        for n in range(1, k):
            far = np.minimum(far, ((x - centres[n - 1]) ** 2).sum(1))
            total = far.sum()
            centres[n] = x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))]
        labels = None
        for _ in range(rounds):
            off = lengths[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
            now = off.argmin(1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            n = np.bincount(labels, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, labels, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        spread = float(off.min(1).sum())
        if spread < best[0]:
            best = (spread, centres)
    return best[1]


def sample_centres(rows: DataFrame, group: str, key: str, vec: str, k: int, sample: int, starts: int = 5) -> DataFrame:
    """(group, side, centre): k-means of each group's vectors, fitted on a hash sample of at most `sample` of them in one task."""
    kind = dict(rows.dtypes)[group]
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(position(key), key))).where(F.col("__n") <= sample)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(key)[vec].to_numpy()).astype(np.float64)
        centres = lloyd(x, k, starts, np.random.default_rng(SEED))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(centres), "side": range(len(centres)), "centre": centres.tolist()})

    return shipped(ranked).select(group, key, vec).groupBy(group).applyInPandas(run, f"`{group}` {kind}, side int, centre array<double>")


def two_sides(rows: DataFrame, label: str, key: str, vec: str, sample: int = 5000) -> DataFrame:
    """(label, key, side): each label's rows on the side of the nearer of two centres, which 2-means fits on a hash sample of the label's rows."""
    clean = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(vec).isNotNull()).select(label, key, F.col(vec).cast("array<double>").alias("v"))
    centres = cut(sample_centres(clean, label, key, "v", 2, sample, 10))
    one, two = (centres.where(F.col("side") == s).select(label, F.col("centre").alias(f"c{s}")) for s in (0, 1))

    def off(c: str) -> Column:
        return F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    # as many centres as labels times two: of the labels with most rows, at most `most` in the audit
    placed = clean.join(F.broadcast(one), label).join(F.broadcast(two), label)
    return placed.select(label, key, (off("c0") <= off("c1")).alias("side"))


def variant_function_test(rows: DataFrame, label: str, key: str, vec: str, folio: str, flag: str, most: int = 150) -> DataFrame:
    """(label, n, observed, p, rank, significant): whether the two visual variants of a label stand at starts of lines unlike often."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.count_distinct(folio).alias("folios")).where("n >= 20 AND folios >= 3")
    asked = counts.orderBy(F.desc("n"), label).limit(most).select(label)
    sides = two_sides(rows.join(asked, label, "left_semi"), label, key, vec)
    both = sides.groupBy(label).agg(F.least(F.count_if("side"), F.count_if(~F.col("side"))).alias("least")).where("least >= 5").select(label)
    ready = cut(rows.select(label, key, folio, flag).join(sides, [label, key]).join(both, label, "left_semi"))
    return stats.benjamini_hochberg(stats.permutation_test(ready, label, "side", flag, [folio]), "p")


def stability(members: DataFrame, variants: DataFrame, key: str, vec: str) -> DataFrame:
    """One row (tested, own_rate, mean_cosine): how often the variants of members (id, cluster_id, vec) fall to their own cluster's centre."""
    centres = graph.centroids(members, "cluster_id", "vec").select(F.col("cluster_id").alias("centroid"), "centre")
    found = nearest_centroid(variants, centres, key, vec)
    own = found.join(members.select(F.col("id"), "cluster_id"), "id")
    return own.agg(F.count("*").alias("tested"), F.avg((F.col("centroid") == F.col("cluster_id")).cast("double")).alias("own_rate"), F.avg("sim").alias("mean_cosine"))


def gate(measures: DataFrame, judged_not_hand: bool = False, passed_visual_audit: bool = False) -> DataFrame:
    """measures (stability, recurrence, significant) with each criterion and admitted, which needs all five.

    Two criteria are judgements from outside the data, false unless given. Null measures don't pass.
    """
    out = measures.withColumn("stable", F.coalesce(F.col("stability") >= 0.80, F.lit(False))).withColumn("recurrent", F.coalesce(F.col("recurrence") >= 0.50, F.lit(False))).withColumn("functional", F.coalesce(F.col("significant") > 0, F.lit(False)))
    out = out.withColumn("not_hand_classifier", F.lit(judged_not_hand)).withColumn("blinded_visual_audit_passed", F.lit(passed_visual_audit))
    return out.withColumn("admitted", F.col("stable") & F.col("recurrent") & F.col("functional") & F.col("not_hand_classifier") & F.col("blinded_visual_audit_passed"))
