"""Statistics of the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.hashing import SPAN, position
from quirework.plans.lineage import cut
from quirework.plans.prefix import running_sum


BUCKETS = 4096


def auc_of_histogram(counts: DataFrame) -> DataFrame:
    """One row (auc, positives, negatives) from (score, same, different): ties count half; null without both kinds.

    Scores are cut into ranges, each summed up in a task of its own.
    """
    ends = counts.agg(F.min("score").cast("double").alias("a"), F.max("score").cast("double").alias("b")).first()
    low, width = ends["a"] or 0.0, max(((ends["b"] or 0.0) - (ends["a"] or 0.0)) / BUCKETS, 1e-300)
    placed = counts.withColumn("__b", F.floor((F.col("score") - F.lit(low)) / F.lit(width)).cast("bigint"))
    won = running_sum(placed, "different", "__upto", "__b", ["score"]).select("same", "different", (F.col("same") * (F.col("__upto") - F.col("different") / 2)).alias("won"))
    totals = won.agg(F.sum("won").alias("won"), F.coalesce(F.sum("same"), F.lit(0)).alias("positives"), F.coalesce(F.sum("different"), F.lit(0)).alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.select(F.when(pairs > 0, F.col("won") / pairs).alias("auc"), "positives", "negatives")


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """The same of single scores; null and NaN scores don't count."""
    counts = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(positive).isNotNull()).groupBy(F.col(score).alias("score"))
    return auc_of_histogram(counts.agg(F.count_if(F.col(positive)).alias("same"), F.count_if(~F.col(positive)).alias("different")))


def retrieval(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (queries, hit_at_1, mrr): the first neighbour of one's label in another group, over all neighbours.

    labels is (id, label, grp); only labels in two groups or more are asked for; without a match the reciprocal rank is 0.
    """
    wide = labels.where("label IS NOT NULL").groupBy("label").agg(F.count_distinct("grp").alias("groups")).where("groups >= 2")
    asked = labels.join(wide, "label", "left_semi")
    a, b = labels.alias("a"), labels.alias("b")
    matches = knn.join(a, F.col("i") == F.col("a.id")).join(b, F.col("j") == F.col("b.id")).where("a.label = b.label AND NOT (a.grp <=> b.grp)")
    first = matches.groupBy("i").agg(F.min("rank").alias("rank"))
    found = asked.join(first, F.col("id") == F.col("i"), "left")
    return found.agg(F.count("*").alias("queries"), F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds rank and significant: all tests up to the last whose p is at most alpha * rank / number.

    Null p-values are last and never significant; ties are ordered by the other columns. Ranks are counted in ranges of p.
    """
    place = F.coalesce(F.floor(F.col(p) * F.lit(BUCKETS)).cast("bigint"), F.lit(2 * BUCKETS))
    placed = tests.withColumn("__one", F.lit(1).cast("bigint")).withColumn("__b", place)
    ranked = cut(running_sum(placed, "__one", "rank", "__b", [F.asc_nulls_last(p), *(F.col(f"`{c}`") for c in tests.columns if c != p)]).drop("__one", "__b"))
    m = ranked.agg(F.count(p)).first()[0]
    last = ranked.where(F.col(p) <= F.lit(alpha) * F.col("rank") / F.lit(max(m, 1))).agg(F.max("rank")).first()[0]
    return ranked.withColumn("significant", (F.col("rank") <= F.lit(last or 0)) & F.col(p).isNotNull())


def permutation_test(rows: DataFrame, group: str, side: str, flag: str, strata: list[str], draws: int = 200, seed: str = "408") -> DataFrame:
    """(group, n, observed, p): the gap in the rate of flag between the two sides, against shuffles of the sides within strata.

    p = (1 + draws with at least the observed gap) / (1 + draws). A shuffle only changes how many flagged rows of a stratum
    the first side gets, and that number is hypergeometric: it is drawn from the counts, by the inverse of its
    distribution at a seeded hash of draw, group and stratum. So a row takes part in one count, whatever the draws.
    """
    names = ["g", *(f"s{i}" for i in range(len(strata)))]
    base = rows.where(F.col(side).isNotNull() & F.col(flag).isNotNull()).select(F.col(group).alias("g"), *(F.col(s).alias(f"s{i}") for i, s in enumerate(strata)), F.col(side).cast("boolean").alias("side"), F.col(flag).cast("boolean").alias("flag"))
    # n rows, k on the first side, f flagged, x both
    counts = cut(base.groupBy(*names).agg(F.count("*").alias("n"), F.count_if("side").alias("k"), F.count_if("flag").alias("f"), F.count_if(F.col("side") & F.col("flag")).alias("x")))
    n, k, f, t = (F.col(c) for c in ("n", "k", "f", "t"))
    least = F.greatest(F.lit(0), f + k - n)
    ratio = F.when(t > least, F.log((f - t + 1) * (k - t + 1) / (t * (n - f - k + t)))).otherwise(0.0)
    along = Window.partitionBy(*names).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*names)
    mass = counts.withColumn("t", F.explode(F.sequence(least, F.least(f, k)))).withColumn("log", F.sum(ratio).over(along))
    mass = mass.withColumn("mass", F.exp(F.col("log") - F.max("log").over(whole)))
    upto = mass.select(*names, (F.sum("mass").over(along) / F.sum("mass").over(whole)).alias("v"), F.lit(None).cast("bigint").alias("draw"), least.alias("least"))
    spot = position("draw", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names), salt=seed) / F.lit(float(SPAN))
    asked = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(*names, spot.alias("v"), F.col("draw").cast("bigint").alias("draw"), least.alias("least"))
    # a draw takes the first value whose distribution exceeds the hash: as many as don't lie before it
    before = F.count_if(F.col("draw").isNull()).over(Window.partitionBy(*names).orderBy("v", F.asc_nulls_first("draw")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = upto.unionByName(asked).withColumn("t", F.col("least") + before).where("draw IS NOT NULL").groupBy("g", "draw").agg(F.sum("t").alias("x"))
    sums = counts.groupBy("g").agg(*(F.sum(c).alias(c) for c in ("n", "k", "f")), F.sum("x").alias("seen"))

    def gap(x: str):
        first = F.when(k > 0, F.col(x) / k)
        return F.abs(first - F.when(n > k, (f - F.col(x)) / (n - k)))

    null = drawn.join(sums, "g").select("g", "n", gap("x").alias("gap"), gap("seen").alias("observed"))
    return null.groupBy("g").agg(F.first("n").alias("n"), F.first("observed").alias("observed"), ((1 + F.count_if(F.col("gap") >= F.col("observed") - 1e-12)) / (1 + F.count("*"))).alias("p")).select(F.col("g").alias(group), "n", "observed", "p")


def neighbour_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, jaccard): how far two tables of neighbours agree on each row."""
    a = first.groupBy("i").agg(F.collect_set("j").alias("a"))
    b = second.groupBy("i").agg(F.collect_set("j").alias("b"))
    return a.join(b, "i").select("i", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def max_similarity(patches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score) of pairs (a, b): the mean, over the patches (id, patch, vec) of a, of the best cosine with a patch of b."""
    from quirework.functions.vectors import dot, norm

    unit = patches.withColumn("vec", F.transform("vec", lambda x: x.cast("double") / F.greatest(norm(F.col("vec")), F.lit(1e-9))))
    sides = pairs.join(unit.select(F.col("id").alias("a"), F.col("patch").alias("pa"), F.col("vec").alias("va")), "a").join(unit.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    best = sides.groupBy("a", "b", "pa").agg(F.max(dot(F.col("va"), F.col("vb"))).alias("m"))
    return best.groupBy("a", "b").agg(F.avg("m").alias("score"))


def sampled_pairs(rows: DataFrame, key: str, label: str, n: int, seed: str = "408") -> DataFrame:
    """(draw, a, b, same): n pairs within labels, the label drawn first, and n pairs of any two rows of different labels.

    Draws are hashes of their number, so they come out alike for every layout. Labels of one row have no pairs; draws
    that hit one row twice, or for the second kind two of one label, are left out. Rows are found by their number: no
    two rows meet that weren't drawn.
    """
    clean = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("l"))
    sizes = clean.groupBy("l").agg(F.count("*").alias("size"))
    # numbering labels and rows: by hash buckets, so that no task sees all
    inside = clean.withColumn("at", F.row_number().over(Window.partitionBy("l").orderBy("k")) - 1)
    bucketed = sizes.where("size >= 2").withColumn("one", F.lit(1)).withColumn("bucket", F.pmod(F.xxhash64("l"), F.lit(1024)))
    eligible = running_sum(bucketed, "one", "number", "bucket", ["l"]).select("l", "size", (F.col("number") - 1).alias("li"))
    labels, whole = eligible.count(), clean.count()
    if not labels or whole < 2:
        return rows.sparkSession.createDataFrame([], f"draw bigint, a {dict(rows.dtypes)[key]}, b {dict(rows.dtypes)[key]}, same boolean")
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw")

    def spot(what: str):
        return position("draw", F.lit(what), salt=seed)

    first = draws.withColumn("li", F.pmod(spot("label"), F.lit(labels))).join(eligible, "li").select("draw", "l", F.pmod(spot("a"), F.col("size")).alias("pa"), F.pmod(spot("b"), F.col("size")).alias("pb"))
    a, b = inside.select("l", F.col("at").alias("pa"), F.col("k").alias("a")), inside.select("l", F.col("at").alias("pb"), F.col("k").alias("b"))
    same = first.join(a, ["l", "pa"]).join(b, ["l", "pb"]).where("a <> b").select("draw", "a", "b", F.lit(True).alias("same"))
    numbered = running_sum(clean.withColumn("one", F.lit(1)).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(1024))), "one", "number", "bucket", ["k"])
    asked = draws.select("draw", F.pmod(spot("x"), F.lit(whole)).alias("x"), F.pmod(spot("y"), F.lit(whole)).alias("y"))
    x, y = numbered.select((F.col("number") - 1).alias("x"), F.col("k").alias("a"), F.col("l").alias("la")), numbered.select((F.col("number") - 1).alias("y"), F.col("k").alias("b"), F.col("l").alias("lb"))
    other = asked.join(x, "x").join(y, "y").where("a <> b AND la <> lb").select("draw", "a", "b", F.lit(False).alias("same"))
    return same.unionByName(other)
