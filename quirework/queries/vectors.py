"""Queries over vectors: neighbours, graph, clusters, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import vectors as V
from quirework.operators import audit, graph, knn, stats
from quirework.operators.relational import zero_filled
from quirework.operators.sampling import display_picks, first_byte, first_members
from quirework.plans.lineage import cut
from quirework.session import table

QUERIES, ORACLE = {}, {}
K, FLOOR, Q94 = 11, 0.0, 0.94
BIG = "bigint"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def near(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return cut(knn.exact_knn(vectors(spark, d), "vec_id", "embedding", k))


U = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
NEAR = U + ", s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM s QUALIFY rank <= {k})"
N11 = NEAR.format(k=K)
EDGES = N11 + f", t AS (SELECT greatest({FLOOR}, quantile_cont(sim, {Q94})) AS threshold FROM n), g AS (SELECT i, j FROM n, t WHERE sim >= threshold), e AS (SELECT DISTINCT g.i, g.j FROM g JOIN g h ON g.i = h.j AND g.j = h.i WHERE g.i < g.j)"
COMPONENTS = EDGES + ", b AS (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e), w(id, m) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, w.m FROM w JOIN b ON w.id = b.a WHERE w.m < b.b), c AS (SELECT id, min(m) AS component FROM w GROUP BY id), z AS (SELECT component, count(*) AS size FROM c GROUP BY component)"
NUMBERED = COMPONENTS + ", y AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS cluster_id FROM z WHERE size BETWEEN 2 AND 2000), m AS (SELECT c.id, c.component, z.size, coalesce(y.cluster_id, -1) AS cluster_id FROM c JOIN z USING (component) LEFT JOIN y USING (component))"
CENTRES = U + ", x AS (SELECT label, d, avg(list_extract(embedding::DOUBLE[], d)) AS m FROM embeddings, generate_series(1, 64) g(d) GROUP BY label, d), l AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-9) AS l FROM x GROUP BY label), c AS (SELECT x.label, list(x.m / l.l ORDER BY d) AS centre FROM x JOIN l USING (label) GROUP BY x.label)"
WITH, WITHR = "WITH ", "WITH RECURSIVE "


@query(WITH + N11 + " SELECT i, j, rank, round(sim, 6) AS sim FROM n")
def knn_exact(spark, d):
    return near(spark, d).select("i", "j", F.col("rank").cast(BIG).alias("rank"), F.round("sim", 6).alias("sim"))


@query(WITH + NEAR.format(k=5) + " SELECT (count(*) >= 0.9 * 5 * (SELECT count(*) FROM u)) AS recall_is_kept FROM n")
def knn_approx(spark, d):
    """Whether the index finds at least nine tenths of the exact five nearest."""
    rows = vectors(spark, d)
    exact = knn.exact_knn(rows, "vec_id", "embedding", 5).select("i", "j")
    found = knn.nearest_rows(rows, "vec_id", "embedding", 5, exact_upto=0).select("i", "j")
    return exact.join(found.withColumn("hit", F.lit(1)), ["i", "j"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("recall_is_kept"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 20).alias("grp"))


@query(WITH + N11 + " SELECT count(*) AS n, round(avg((a.label = b.label)::INT), 6) AS label_at_1, round(avg((a.vec_id % 20 = b.vec_id % 20)::INT), 6) AS group_at_1 FROM n JOIN u a ON i = a.vec_id JOIN u b ON j = b.vec_id WHERE rank = 1")
def knn_label_at1(spark, d):
    a, b = _labels(spark, d).alias("a"), _labels(spark, d).alias("b")
    both = near(spark, d).where("rank = 1").join(a, F.col("i") == F.col("a.id")).join(b, F.col("j") == F.col("b.id"))
    rate = lambda c: F.round(F.avg((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("double")), 6)
    return both.agg(F.count("*").alias("n"), rate("label").alias("label_at_1"), rate("grp").alias("group_at_1"))


RETRIEVED = """, l AS (SELECT label FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id % 20) >= 2),
 f AS (SELECT n.i, min(rank) AS rank FROM n JOIN u a ON i = a.vec_id JOIN u b ON j = b.vec_id WHERE a.label = b.label AND a.vec_id % 20 <> b.vec_id % 20 GROUP BY n.i)
 SELECT count(*) AS queries, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM embeddings SEMI JOIN l USING (label) LEFT JOIN f ON i = vec_id"""


@query(WITH + NEAR.format(k=99) + RETRIEVED)
def knn_mrr(spark, d):
    found = stats.retrieval(near(spark, d, 99), _labels(spark, d))
    return found.select("queries", F.round("hit_at_1", 6).alias("hit_at_1"), F.round("mrr", 6).alias("mrr"))


AUC = """p AS (SELECT round(list_inner_product(a.v, b.v) * 1000000)::BIGINT AS score, a.label = b.label AS same FROM u a JOIN u b ON a.vec_id < b.vec_id),
 h AS (SELECT score, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS different FROM p GROUP BY score),
 r AS (SELECT *, coalesce(sum(different) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
 SELECT round(sum(same * (below + different / 2)) / (sum(same)::DOUBLE * sum(different)::DOUBLE), 6) AS auc, sum(same)::BIGINT AS positives, sum(different)::BIGINT AS negatives FROM r"""


@query(WITH + U + ", " + AUC)
def pair_auc(spark, d):
    found = stats.auc_of_histogram(knn.pair_histogram(vectors(spark, d), "vec_id", "embedding", "label"))
    return found.select(F.round("auc", 6).alias("auc"), "positives", "negatives")


@query(WITH + N11 + f" SELECT round(greatest({FLOOR}, quantile_cont(sim, {Q94})), 6) AS threshold, count(*) AS n FROM n")
def knn_threshold(spark, d):
    table_ = near(spark, d)
    return graph.similarity_threshold(table_, FLOOR, Q94).select(F.round("threshold", 6).alias("threshold"), F.lit(table_.count()).cast(BIG).alias("n"))


def _discovered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    # the floor of 0.82 leaves no edge between these vectors, and mutual groups are small
    return audit.discovered(vectors(spark, d), "vec_id", "embedding", K, FLOOR, Q94, (2, 2000))


@query(WITH + EDGES + " SELECT i, j FROM e")
def mutual_edges(spark, d):
    return _discovered(spark, d)[1]


@query(WITHR + COMPONENTS + " SELECT id, component FROM c")
def components(spark, d):
    return _discovered(spark, d)[0].select("id", "component")


@query(WITHR + NUMBERED + " SELECT cluster_id, size FROM (SELECT DISTINCT cluster_id, size FROM m WHERE cluster_id >= 0)")
def cluster_sizes(spark, d):
    return _discovered(spark, d)[0].where("cluster_id >= 0").select("cluster_id", "size").distinct()


@query(WITHR + NUMBERED + ", k AS (SELECT count(*) AS n FROM embeddings) SELECT any_value(n) - count(*) FILTER (cluster_id >= 0) AS outside, round(1 - count(*) FILTER (cluster_id >= 0) / any_value(n), 6) AS rate, (SELECT count(*) FROM e) AS edges FROM m, k")
def unclustered_rate(spark, d):
    found, edges, _ = _discovered(spark, d)
    n = vectors(spark, d).count()
    return found.agg(F.count_if(F.col("cluster_id") >= 0).alias("i")).select((n - F.col("i")).alias("outside"), F.round(1 - F.col("i") / n, 6).alias("rate"), F.lit(edges.count()).cast(BIG).alias("edges"))


REPORT = """, v AS (SELECT m.cluster_id, u.vec_id, u.v, e2.embedding::DOUBLE[] AS r, u.vec_id % 20 AS folio, 't' || (u.label % 3) AS kind FROM m JOIN u ON m.id = u.vec_id JOIN embeddings e2 ON e2.vec_id = u.vec_id WHERE cluster_id >= 0),
 x AS (SELECT cluster_id, d, avg(list_extract(r, d)) AS a FROM v, generate_series(1, 64) q(d) GROUP BY cluster_id, d), l AS (SELECT cluster_id, sqrt(sum(a * a)) AS l FROM x GROUP BY cluster_id),
 ce AS (SELECT x.cluster_id, list(a / l ORDER BY d) AS centre FROM x JOIN l USING (cluster_id) GROUP BY x.cluster_id),
 sc AS (SELECT v.cluster_id, vec_id, folio, kind, list_inner_product(v.v, centre) AS sim FROM v JOIN ce USING (cluster_id)),
 kf AS (SELECT cluster_id, folio, count(*) AS n FROM sc GROUP BY ALL), tf AS (SELECT cluster_id, list(folio ORDER BY n DESC, folio)[1] AS top_folio FROM kf GROUP BY cluster_id)
 SELECT sc.cluster_id, count(*) AS size, count(DISTINCT folio) AS distinct_folios, any_value(top_folio) AS top_folio, round(avg(sim), 6) AS mean_centroid_cosine, round(quantile_cont(sim, 0.05), 6) AS p05_centroid_cosine, arg_max(vec_id, (round(sim, 9), -vec_id)) AS medoid, count(*) FILTER (kind = 't0') AS of_kind_t0 FROM sc JOIN tf USING (cluster_id) GROUP BY sc.cluster_id"""


@query(WITHR + NUMBERED + REPORT)
def cluster_report(spark, d):
    rows = vectors(spark, d)
    found = audit.cluster_report(rows, _discovered(spark, d)[0], "vec_id", "embedding", F.col("vec_id") % 20, F.concat(F.lit("t"), F.col("label") % 3))
    return found.select("cluster_id", "size", "distinct_folios", F.get("top_folios", F.lit(0))["folio"].alias("top_folio"), F.round("mean_centroid_cosine", 6).alias("mean_centroid_cosine"), F.round("p05_centroid_cosine", 6).alias("p05_centroid_cosine"), "medoid", F.coalesce(F.try_element_at("proposal_types", F.lit("t0")), F.lit(0)).alias("of_kind_t0"))


@query(WITH + CENTRES + " SELECT label, count(*) AS size, any_value(round(list_extract(centre, 1), 6)) AS first_value, any_value(round(list_aggregate(centre, 'sum'), 6)) AS total FROM c JOIN embeddings USING (label) GROUP BY label")
def centroids(spark, d):
    found = graph.centroids(vectors(spark, d), "label", "embedding")
    return found.select("label", "size", F.round(F.get("centre", F.lit(0)), 6).alias("first_value"), F.round(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(WITH + CENTRES + " SELECT u.label, arg_max(vec_id, (round(list_inner_product(v, centre), 9), -vec_id)) AS medoid, round(avg(list_inner_product(v, centre)), 6) AS mean_cosine, round(quantile_cont(list_inner_product(v, centre), 0.05), 6) AS p05 FROM u JOIN c ON u.label = c.label GROUP BY u.label")
def medoids(spark, d):
    rows = vectors(spark, d).withColumn("cluster_id", F.col("label"))
    labels = rows.select(F.col("vec_id").alias("id"), F.col("label").cast(BIG).alias("cluster_id"))
    found = audit.cluster_report(vectors(spark, d), labels, "vec_id", "embedding", F.lit("f"), F.lit("k"))
    return found.select(F.col("cluster_id").cast("int").alias("label"), "medoid", F.round("mean_centroid_cosine", 6).alias("mean_cosine"), F.round("p05_centroid_cosine", 6).alias("p05"))


@query(WITH + CENTRES + " , b AS (SELECT vec_id, u.label, arg_max(c.label, (list_inner_product(v, centre), -c.label)) AS assigned FROM u, c GROUP BY vec_id, u.label) SELECT label, assigned, count(*) AS n FROM b GROUP BY ALL")
def nearest_centroid(spark, d):
    centres = graph.centroids(vectors(spark, d), "label", "embedding").select(F.col("label").cast(BIG).alias("centroid"), "centre")
    found = knn.nearest_centroid(vectors(spark, d), centres, "vec_id", "embedding")
    return found.join(vectors(spark, d).select(F.col("vec_id").alias("id"), "label"), "id").groupBy("label", F.col("centroid").cast("int").alias("assigned")).agg(F.count("*").alias("n"))


VIEWS = "w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) AS a FROM embeddings), r AS (SELECT vec_id, a, list_reverse(a) AS b FROM w), f AS (SELECT vec_id, a, list_transform(generate_series(1, 64), lambda i: a[i] + b[i]) AS s FROM (SELECT vec_id, a, list_transform(b, lambda x: x / (sqrt(list_inner_product(b, b)) + 1e-9)) AS b FROM (SELECT vec_id, list_transform(a, lambda x: x / (sqrt(list_inner_product(a, a)) + 1e-9)) AS a, b FROM r)))"


@query(WITH + VIEWS + " SELECT vec_id, round(list_aggregate(a, 'sum'), 6) AS renormed, round(list_aggregate(s, 'sum') / (sqrt(list_inner_product(s, s)) + 1e-9), 6) AS fused FROM f")
def vector_fused(spark, d):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    a = V.renormalised(F.col("embedding"))
    rows = vectors(spark, d).select("vec_id", a.alias("a"), F.reverse(a).alias("b"))
    return rows.select("vec_id", total(V.renormalised(F.col("a"))).alias("renormed"), total(V.fused(F.col("a"), F.col("b"))).alias("fused"))


HALF = "SELECT vec_id, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS v FROM (SELECT vec_id, list_slice(embedding::DOUBLE[], {0}, {1}) AS h FROM embeddings)"
HALVES = f"p AS ({HALF.format(1, 32)}), q AS ({HALF.format(33, 64)})" + "".join(f", n{t} AS (SELECT i, list(j) AS js FROM (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS r FROM {t} a JOIN {t} b ON a.vec_id <> b.vec_id QUALIFY r <= 10) GROUP BY i)" for t in "pq")


@query(WITH + HALVES + " SELECT count(*) AS n, round(avg(len(list_intersect(np.js, nq.js)) / len(list_distinct(list_concat(np.js, nq.js)))), 6) AS jaccard FROM np JOIN nq USING (i)")
def model_agreement(spark, d):
    halves = [vectors(spark, d).select("vec_id", F.slice("embedding", s, 32).alias("h")) for s in (1, 33)]
    found = stats.neighbour_agreement(*(knn.exact_knn(h, "vec_id", "h", 10) for h in halves))
    return found.agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 6).alias("jaccard"))


HELD = "('0x' || substr(sha256('408:' || {0}), 1, 2))::INT < 52"


@query(f"WITH r AS (SELECT label, vec_id % 40 AS folio, {HELD.format('(vec_id % 36)')} AS held, vec_id % 5 <> 0 AS ok FROM embeddings), c AS (SELECT label, count(*) FILTER (NOT held) AS tn, count(DISTINCT folio) FILTER (NOT held) AS tf, count(*) FILTER (held AND ok) AS hn, count(DISTINCT folio) FILTER (held AND ok) AS hf FROM r GROUP BY label) SELECT count(*) FILTER (tn >= 10 AND tf >= 3) AS eligible, count(*) FILTER (tn >= 10 AND tf >= 3 AND hn >= 3 AND hf >= 2) AS recurrent, round(count(*) FILTER (tn >= 10 AND tf >= 3 AND hn >= 3 AND hf >= 2) / greatest(1, count(*) FILTER (tn >= 10 AND tf >= 3)), 6) AS fraction FROM c")
def holdout_recurrence(spark, d):
    rows = vectors(spark, d).select("label", (F.col("vec_id") % 40).alias("folio"), audit.held_out(F.col("vec_id") % 36).alias("held"), (F.col("vec_id") % 5 != 0).alias("ok"))
    return audit.recurrence(rows, "label", "folio", "held", "ok").select("eligible", "recurrent", F.round("fraction", 6).alias("fraction"))


@query()
def kmeans_holdout(spark, d):
    return audit.holdout_test(vectors(spark, d).withColumn("folio", F.concat(F.lit("f"), F.col("vec_id") % 40)), "vec_id", "embedding", "folio", F.col("vec_id") % 36)


@query()
def leakage_logreg(spark, d):
    return audit.leakage(vectors(spark, d).withColumn("grp", F.col("vec_id") % 23), "embedding", "label", "grp")


@query()
def variant_function(spark, d):
    rows = vectors(spark, d).withColumn("folio", F.concat(F.lit("f"), F.col("vec_id") % 9)).withColumn("line_start", F.col("vec_id") % 4 == 0)
    return audit.variant_function_test(rows, "label", "vec_id", "embedding", "folio", "line_start")


@query(WITH + NEAR.format(k=99) + ", f AS (SELECT n.i, min(rank) AS rank FROM n JOIN u a ON i = a.vec_id JOIN u b ON j = b.vec_id WHERE a.label = b.label AND a.vec_id % 20 <> b.vec_id % 20 GROUP BY n.i), " + AUC.split("SELECT round(sum(same *")[0].replace(" r AS (", " r0 AS (").rstrip() + ", z AS (SELECT round(sum(same * (below + different / 2)) / (sum(same)::DOUBLE * sum(different)::DOUBLE), 6) AS auc FROM r0), l AS (SELECT label FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id % 20) >= 2), o AS (SELECT count(*) AS n, round(avg((a.label = b.label)::INT), 6) AS exact_label_nn, round(avg((a.vec_id % 20 = b.vec_id % 20)::INT), 6) AS nearest_same_group FROM n JOIN u a ON i = a.vec_id JOIN u b ON j = b.vec_id WHERE rank = 1), q AS (SELECT count(*) AS queries, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM embeddings SEMI JOIN l USING (label) LEFT JOIN f ON i = vec_id) SELECT o.*, q.*, z.* FROM o, q, z")
def word_audit(spark, d):
    found = audit.word_audit(vectors(spark, d).withColumn("grp", F.col("vec_id") % 20), "vec_id", "embedding", "label", "grp")
    return found.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


SHIFTED = "list_transform(generate_series(1, 64), lambda i: embedding[i]::DOUBLE + 0.05 * sin(vec_id * 7 + i))"


@query(WITH + CENTRES + f", s AS (SELECT vec_id, label, {SHIFTED} AS h FROM embeddings), b AS (SELECT s.vec_id, s.label, arg_max(c.label, list_inner_product(h, centre)) AS assigned, max(list_inner_product(h, centre) / sqrt(list_inner_product(h, h))) AS sim FROM s, c GROUP BY s.vec_id, s.label) SELECT count(*) AS tested, round(avg((label = assigned)::INT), 6) AS own_rate, round(avg(sim), 6) AS mean_cosine FROM b")
def stability_sim(spark, d):
    members = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast(BIG).alias("cluster_id"), F.col("embedding").alias("vec"))
    moved = members.select("id", F.transform("vec", lambda x, i: x.cast("double") + 0.05 * F.sin(F.col("id") * 7 + i + 1)).alias("vec"))
    return audit.stability(members, moved, "id", "vec").select("tested", F.round("own_rate", 6).alias("own_rate"), F.round("mean_cosine", 6).alias("mean_cosine"))


@query(WITH + CENTRES + f", s AS (SELECT vec_id, label, {SHIFTED} AS h FROM embeddings), b AS (SELECT s.vec_id, s.label, arg_max(c.label, list_inner_product(h, centre)) AS assigned FROM s, c GROUP BY s.vec_id, s.label), r AS (SELECT round(avg((label = assigned)::INT), 6) AS stability FROM b) SELECT stability, 0.6::DOUBLE AS recurrence, 3 AS significant, stability >= 0.8 AS stable, true AS recurrent, true AS functional, false AS admitted FROM r")
def gate_verdict(spark, d):
    measures = stability_sim(spark, d).select(F.col("own_rate").alias("stability"), F.lit(0.6).alias("recurrence"), F.lit(3).alias("significant"))
    return audit.gate(measures).select("stability", "recurrence", "significant", "stable", "recurrent", "functional", "admitted")


PATCHES = "k AS (SELECT vec_id, g.p, list_slice(embedding::DOUBLE[], g.p * 16 + 1, g.p * 16 + 16) AS h FROM embeddings, generate_series(0, 3) g(p)), t AS (SELECT vec_id, p, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS h FROM k)"


@query(WITH + PATCHES + ", m AS (SELECT a.vec_id AS a, b.vec_id AS b, a.p, max(list_inner_product(a.h, b.h)) AS m FROM t a JOIN t b ON b.vec_id = a.vec_id + 1 GROUP BY ALL) SELECT a, b, round(avg(m), 6) AS score FROM m GROUP BY a, b")
def maxsim(spark, d):
    rows = vectors(spark, d)
    patches = rows.select(F.col("vec_id").alias("id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, F.lit(16)))).alias("patch", "vec"))
    following = rows.select(F.col("vec_id").alias("b"))
    pairs = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(following, "b")
    return stats.max_similarity(patches, pairs).select("a", "b", F.round("score", 6).alias("score"))


@query(WITH + N11 + " SELECT i, j FROM (SELECT n.i, n.j, n.sim, m.sim AS second FROM n JOIN n m ON n.i = m.i AND n.rank = 1 AND m.rank = 2) WHERE 1 - sim < 0.97 * (1 - second)")
def ratio_test(spark, d):
    from quirework.operators.registration import ratio_matches

    two = near(spark, d).where("rank <= 2").select(F.col("i").alias("q"), F.col("j").alias("t"), (1 - F.col("sim")).alias("distance"), "rank")
    return ratio_matches(two, 0.97).select(F.col("q").alias("i"), F.col("t").alias("j"))


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 12")
def first_k_members(spark, d):
    return first_members(vectors(spark, d), "label", "vec_id", 12).select("vec_id", "label")


@query("WITH f AS (SELECT label, vec_id, 1 AS o FROM embeddings QUALIFY row_number() OVER (PARTITION BY label, vec_id % 20 ORDER BY vec_id) = 1), a AS (SELECT label, max(vec_id) AS vec_id, 0 AS o FROM embeddings GROUP BY label UNION ALL SELECT * FROM f) SELECT label, vec_id, pick FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY o, vec_id) - 1 AS pick FROM a) WHERE pick < 6")
def display_pick(spark, d):
    rows = vectors(spark, d).withColumn("folio", F.col("vec_id") % 20)
    medoid = rows.groupBy("label").agg(F.max("vec_id").alias("vec_id"))
    return display_picks(rows, medoid, "label", "vec_id", "folio").withColumn("pick", F.col("pick").cast(BIG))


@query("SELECT b AS bucket, count(vec_id) AS n FROM generate_series(0, 15) g(b) LEFT JOIN embeddings ON label = b GROUP BY b")
def zero_filled_counts(spark, d):
    counts = vectors(spark, d).groupBy(F.col("label").cast(BIG).alias("bucket")).agg(F.count("*").alias("n"))
    return zero_filled(counts, 16, "bucket", "n")


@query("SELECT count(*) AS n, count(*) FILTER (" + HELD.format("vec_id") + ") AS held FROM embeddings")
def hash_share(spark, d):
    return vectors(spark, d).agg(F.count("*").alias("n"), F.count_if(first_byte("vec_id") < 52).alias("held"))


@query()
def sampled_auc(spark, d):
    """The AUC over drawn pairs, labels drawn before members."""
    rows = vectors(spark, d)
    pairs = stats.sampled_pairs(rows, "vec_id", "label", 4000)
    v = lambda c: rows.select(F.col("vec_id").alias(c), F.col("embedding").alias(f"v{c}"))
    scored = pairs.join(v("a"), "a").join(v("b"), "b").select("same", F.round(V.dot(F.col("va"), F.col("vb")) / (V.norm(F.col("va")) * V.norm(F.col("vb"))), 6).alias("score"))
    return stats.auc(scored, "score", "same").select(F.round("auc", 6).alias("auc"), "positives", "negatives")
