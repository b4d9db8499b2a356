"""Queries over tables: keys, candidates, registrations, words, proposals, samples, frequencies, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.config import CURRENT_LIMITS, leaf_pairs
from quirework.functions import geometry as G
from quirework.functions.folio import folio_form, folio_form_sql
from quirework.functions.hashing import SPAN, position_sql
from quirework.functions.text import derivative_url, json_safe, leaf_base, whole_token
from quirework.operators import layout, proposals, registration, relational, stats
from quirework.operators.audit import held_out
from quirework.operators.sampling import byte_sample, stratified_cap
from quirework.session import table
from quirework.sources import readers, sinks
from quirework.streaming import windows

QUERIES, ORACLE = {}, {}
BIG = "bigint"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# keys, labels, addresses


@query(r"SELECT DISTINCT folio, TRY_CAST(regexp_extract(lower(folio), '^f([0-9]+)([rv])([0-9]+)?\z', 1) AS INT) AS n, regexp_extract(lower(folio), '^f([0-9]+)([rv])([0-9]+)?\z', 2) AS side FROM proposals WHERE regexp_matches(lower(folio), '^f([0-9]+)([rv])([0-9]+)?\z')")
def regex_key_parse(spark, d):
    keys = table(spark, d, "proposals").select("folio", leaf_base(F.col("folio")).alias("k")).where("k IS NOT NULL")
    return keys.select("folio", "k.n", "k.side").distinct()


@query("SELECT DISTINCT body_id, regexp_replace(body_id, '/full/full/0/default\\.jpg(\\?.*)?$', '/full/1800,/0/default.jpg') AS derivative_url FROM registrations WHERE body_id IS NOT NULL")
def url_rewrite(spark, d):
    return table(spark, d, "registrations").where("body_id IS NOT NULL").select("body_id", derivative_url(F.col("body_id"), 1800).alias("derivative_url")).distinct()


@query(rf"SELECT reg_id, regexp_matches(lower(candidate_label), '(^|[^0-9])' || regexp_extract(f, '^f([0-9]+[rv])', 1) || '([^0-9]|$)') AS named FROM (SELECT DISTINCT reg_id, candidate_label, {folio_form_sql('folio')} AS f FROM registrations WHERE candidate_label IS NOT NULL) WHERE f IS NOT NULL")
def whole_token_match(spark, d):
    rows = table(spark, d, "registrations").select("reg_id", "candidate_label", folio_form(F.col("folio")).alias("f")).where("candidate_label IS NOT NULL AND f IS NOT NULL").distinct()
    return rows.select("reg_id", whole_token(F.col("candidate_label"), F.regexp_extract("f", "^f([0-9]+[rv])", 1)).alias("named"))


SMOKE = "('f1r', 'f3v', 'f45r', 'f57v', 'f67r2')"


@query(f"SELECT folio, count(*) AS n FROM (SELECT {folio_form_sql('folio')} AS folio FROM proposals) WHERE folio IN {SMOKE} GROUP BY folio")
def id_subset(spark, d):
    named = spark.createDataFrame([(x,) for x in ("f1r", "f3v", "f45r", "f57v", "f67r2")], "folio string")
    return table(spark, d, "proposals").select(folio_form(F.col("folio")).alias("folio")).join(F.broadcast(named), "folio", "left_semi").groupBy("folio").agg(F.count("*").alias("n"))


# candidates: label tokens as equi-joins

CANVASES = "SELECT DISTINCT candidate_index AS index, candidate_label AS label FROM registrations WHERE candidate_index IS NOT NULL AND candidate_label IS NOT NULL"
TOKENS = f"tk AS (SELECT index, unnest(regexp_extract_all(regexp_replace(lower(label), '([rv])([0-9])', '\\1~\\2', 'g'), '[0-9]+[rv]~?')) AS token FROM ({CANVASES})), to_ AS (SELECT DISTINCT index, token FROM tk WHERE NOT contains(token, '~'))"
KEYS = r"ky AS (SELECT DISTINCT folio, TRY_CAST(regexp_extract(lower(folio), '^f([0-9]+)', 1) AS INT) AS n, regexp_extract(lower(folio), '^f[0-9]+([rv])', 1) AS side FROM folio_inventory WHERE regexp_matches(lower(folio), '^f([0-9]+)([rv])([0-9]+)?\z'))"
EXACT = "ex AS (SELECT folio, index FROM ky JOIN to_ ON token = n || side)"


def _canvases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registrations").select(F.col("candidate_index").alias("index"), F.col("candidate_label").alias("label")).where("index IS NOT NULL AND label IS NOT NULL").distinct()


@query(f"WITH {TOKENS}, {KEYS}, {EXACT}, nr AS (SELECT folio, index FROM (SELECT folio, unnest([n - 1, n, n + 1]) AS m FROM ky ANTI JOIN ex USING (folio)) JOIN to_ ON token IN (m || 'r', m || 'v')) SELECT DISTINCT folio, index FROM (SELECT * FROM ex UNION ALL SELECT * FROM nr)")
def token_theta_join(spark, d):
    return registration.candidates(table(spark, d, "folio_inventory").select("folio"), _canvases(spark, d))


@query(f"WITH {TOKENS}, {KEYS}, nr AS (SELECT folio, index FROM (SELECT folio, unnest([n - 1, n, n + 1]) AS m FROM ky) JOIN to_ ON token IN (m || 'r', m || 'v')) SELECT folio, count(DISTINCT index) AS candidates FROM nr GROUP BY folio")
def broad_candidates(spark, d):
    return registration.candidates(table(spark, d, "folio_inventory").select("folio"), _canvases(spark, d), broad=True).groupBy("folio").agg(F.count("*").alias("candidates"))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON abs(c_nationkey - n_nationkey) <= 1 GROUP BY n_name")
def band_join(spark, d):
    both = relational.band_join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey", 1)
    return both.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# registrations

PLAUSIBLE = "(intersection_ratio >= 0.8 AND target_area_ratio BETWEEN 0.005 AND 1.5)"
ACCEPTED = "coalesce(plausible_intersection AND inliers >= 50 AND (inlier_ratio >= 0.55 AND NOT isnan(inlier_ratio)) AND (median_reprojection_px <= 3.0 AND NOT isnan(median_reprojection_px)), false)"


@query(f"SELECT plausible_intersection AS plausible, {ACCEPTED} AS accepted, count(*) AS n FROM (SELECT DISTINCT reg_id, plausible_intersection, inliers, inlier_ratio, median_reprojection_px FROM registrations) GROUP BY ALL")
def gate_counts(spark, d):
    rows = table(spark, d, "registrations").select("reg_id", "plausible_intersection", "inliers", "inlier_ratio", "median_reprojection_px").distinct()
    return rows.groupBy(F.col("plausible_intersection").alias("plausible"), registration.accepted().alias("accepted")).agg(F.count("*").alias("n"))


ONCE = f"(SELECT DISTINCT reg_id, {folio_form_sql('folio')} AS folio, candidate_index, candidate_label, target_width, inliers, inlier_ratio, median_reprojection_px, p95_reprojection_px, accepted, error FROM registrations)"
MERIT = "coalesce(accepted, false) DESC, coalesce(inliers, -1) DESC, CASE WHEN isnan(inlier_ratio) THEN -1 ELSE coalesce(inlier_ratio, -1) END DESC, CASE WHEN isnan(median_reprojection_px) THEN 'inf'::DOUBLE ELSE coalesce(median_reprojection_px, 'inf'::DOUBLE) END"
CHOSEN = f"ch AS (SELECT * FROM {ONCE} WHERE folio IS NOT NULL AND (coalesce(accepted, false) OR error IS NULL) QUALIFY row_number() OVER (PARTITION BY folio ORDER BY {MERIT}, candidate_index NULLS LAST, reg_id) = 1)"


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    columns = ["reg_id", "candidate_index", "candidate_label", "target_width", "inliers", "inlier_ratio", "median_reprojection_px", "p95_reprojection_px", "accepted", "error"]
    rows = table(spark, d, "registrations").select(folio_form(F.col("folio")).alias("folio"), *columns).distinct()
    return registration.selected(rows)


@query(f"WITH {CHOSEN} SELECT folio, reg_id, coalesce(accepted, false) AS accepted FROM ch")
def argmax_per_group(spark, d):
    return _chosen(spark, d).select("folio", "reg_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query(f"WITH b AS (SELECT * FROM {ONCE} WHERE folio IS NOT NULL AND candidate_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folio, candidate_index ORDER BY {MERIT}, target_width DESC NULLS LAST) = 1) SELECT folio, candidate_index, target_width AS best_width FROM b")
def best_scale(spark, d):
    columns = ["candidate_index", "target_width", "inliers", "inlier_ratio", "median_reprojection_px", "accepted"]
    rows = table(spark, d, "registrations").select(folio_form(F.col("folio")).alias("folio"), *columns, F.col("target_width").alias("registration_scale_width")).where("folio IS NOT NULL AND candidate_index IS NOT NULL").distinct()
    return registration.best_scale(rows, ["folio", "candidate_index"]).select("folio", "candidate_index", F.col("target_width").alias("best_width"))


@query(f"WITH {CHOSEN} SELECT count(*) AS accepted, median(inliers) AS median_inliers, round(median(inlier_ratio), 6) AS median_ratio, round(median(median_reprojection_px), 6) AS median_px, round(quantile_cont(p95_reprojection_px, 0.95), 6) AS p95_px FROM ch WHERE accepted")
def registration_report(spark, d):
    return registration.report(_chosen(spark, d)).select("accepted", "median_inliers", r6("median_ratio").alias("median_ratio"), r6("median_px").alias("median_px"), r6("p95_px").alias("p95_px"))


@query(f"WITH {CHOSEN}, i AS (SELECT DISTINCT {folio_form_sql('folio')} AS folio FROM folio_inventory) SELECT coalesce(accepted, false) AS accepted, count(*) AS folios FROM i LEFT JOIN ch USING (folio) WHERE i.folio IS NOT NULL GROUP BY 1")
def accept_split(spark, d):
    folios = table(spark, d, "folio_inventory").select(folio_form(F.col("folio")).alias("folio")).where("folio IS NOT NULL").distinct()
    return registration.accept_split(folios, _chosen(spark, d)).groupBy("accepted").agg(F.count("*").alias("folios"))


@query(f"WITH {CHOSEN}, ru AS (SELECT folio, candidate_index, candidate_label FROM ch WHERE NOT coalesce(accepted, false) AND candidate_label IS NOT NULL) SELECT acceptance_basis, count(*) AS n FROM (SELECT CASE WHEN coalesce(accepted, false) THEN 'automatic' WHEN candidate_label IS NOT NULL AND candidate_index IS NOT NULL AND inliers >= 20 AND inlier_ratio >= 0.2 AND NOT isnan(inlier_ratio) AND median_reprojection_px <= 6 AND NOT isnan(median_reprojection_px) THEN 'adjudicated' END AS acceptance_basis FROM ch) GROUP BY 1")
def rule_adjudication(spark, d):
    chosen = _chosen(spark, d)
    rules = chosen.where("NOT coalesce(accepted, false) AND candidate_label IS NOT NULL").select("folio", "candidate_index", "candidate_label", F.lit(20).alias("min_inliers"), F.lit(0.2).alias("min_ratio"), F.lit(6.0).alias("max_median_px"), F.lit(True).alias("evidence"))
    return registration.adjudicated(chosen, rules).groupBy("acceptance_basis").agg(F.count("*").alias("n"))


FINITE = "CASE WHEN isfinite({0}) THEN {0} END"


@query(f"SELECT reg_id, {FINITE.format('inlier_ratio')} AS inlier_ratio, {FINITE.format('median_reprojection_px')} AS median_reprojection_px FROM registrations GROUP BY ALL")
def sanitize_nonfinite(spark, d):
    return table(spark, d, "registrations").select("reg_id", *(json_safe(F.col(c)).alias(c) for c in ("inlier_ratio", "median_reprojection_px"))).distinct()


@query("""SELECT reg_id, intersection_ratio >= 0.8 AND NOT isnan(intersection_ratio) AND target_area_ratio >= 0.005 AND target_area_ratio <= 1.5 AND NOT isnan(target_area_ratio)
 AND len(list_filter(flatten(homography_derivative), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS plausible FROM (SELECT DISTINCT reg_id, intersection_ratio, target_area_ratio, homography_derivative FROM registrations)""")
def plausibility(spark, d):
    """Whether each registration is plausible, from its own measures, not the stored flag."""
    rows = table(spark, d, "registrations").select("reg_id", "intersection_ratio", "target_area_ratio", "homography_derivative").distinct()
    return rows.select("reg_id", registration.plausible().alias("plausible"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Points of each registration and where they might have been found: 24 of a grid, the inliers off by less than the others."""
    rows = table(spark, d, "registrations").select("reg_id", "homography_derivative").where("size(homography_derivative) = 3").distinct()
    k = F.col("k")
    grid = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("x1", (k % 6) * 40.0).withColumn("y1", F.floor(k / 6) * 30.0)
    p = G.mapped_point(F.col("homography_derivative"), F.col("x1"), F.col("y1"))
    off = F.when(k % 5 == 0, 9.0).otherwise((k % 7) * 0.4)
    return grid.select("reg_id", "homography_derivative", "x1", "y1", (p["x"] + off).alias("x2"), (p["y"] - off / 2).alias("y2"), (k % 5 != 0).alias("inlier"))


@query("""WITH r AS (SELECT DISTINCT reg_id, homography_derivative AS h FROM registrations WHERE len(homography_derivative) = 3), m AS (SELECT reg_id, k, CASE WHEN k % 5 = 0 THEN 9.0 ELSE (k % 7) * 0.4 END AS off, h[3][1] * ((k % 6) * 40.0) + h[3][2] * ((k // 6) * 30.0) + h[3][3] AS z FROM r, generate_series(0, 23) q(k)),
 e AS (SELECT reg_id, k % 5 <> 0 AS inlier, CASE WHEN z <> 0 THEN sqrt(off * off + off * off / 4)::DOUBLE END AS error FROM m)
 SELECT reg_id, count(*)::INT AS matches, count(*) FILTER (inlier)::INT AS inliers, round(avg(inlier::INT), 6) AS inlier_ratio, round(median(error) FILTER (inlier), 3) AS median_px, round(quantile_cont(error, 0.95) FILTER (inlier), 3) AS p95_px FROM e GROUP BY reg_id""")
def reprojection_errors(spark, d):
    found = registration.reprojection(_matches(spark, d), ["reg_id"])
    return found.select("reg_id", "matches", "inliers", r6("inlier_ratio").alias("inlier_ratio"), F.round("median_reprojection_px", 3).alias("median_px"), F.round("p95_reprojection_px", 3).alias("p95_px"))


# geometry, with the registrations' own homographies and quadrilaterals

QUAD = "len(homography_full) = 3 AND len(target_quad_full) = 4"
DETS = "SELECT DISTINCT reg_id, canvas_width, canvas_height, target_width, homography_full AS h, target_quad_full AS q FROM registrations WHERE " + QUAD


def _quads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "registrations").select("reg_id", "canvas_width", "canvas_height", "target_width", F.col("homography_full").alias("h"), F.col("target_quad_full").alias("q"))
    return rows.where("size(h) = 3 AND size(q) = 4").distinct()


PX = "(h[1][1] * {0} + h[1][2] * {1} + h[1][3]) / (h[3][1] * {0} + h[3][2] * {1} + h[3][3])"
PY = "(h[2][1] * {0} + h[2][2] * {1} + h[2][3]) / (h[3][1] * {0} + h[3][2] * {1} + h[3][3])"


@query(f"SELECT reg_id, round({PX.format(100, 50)}, 6) AS x, round({PY.format(100, 50)}, 6) AS y FROM ({DETS})")
def homography_points(spark, d):
    p = G.mapped_point(F.col("h"), F.lit(100.0), F.lit(50.0))
    return _quads(spark, d).select("reg_id", p.alias("p")).select("reg_id", r6("p.x").alias("x"), r6("p.y").alias("y"))


CORNERS = [(10, 20), (110, 20), (110, 60), (10, 60)]
XS, YS = ", ".join(PX.format(*c) for c in CORNERS), ", ".join(PY.format(*c) for c in CORNERS)


@query(f"SELECT reg_id, floor(least({XS}))::BIGINT AS x, floor(least({YS}))::BIGINT AS y, (ceil(greatest({XS})) - floor(least({XS})))::BIGINT AS w, (ceil(greatest({YS})) - floor(least({YS})))::BIGINT AS h FROM ({DETS})")
def rect_map(spark, d):
    box = G.bounding_box(G.mapped_rect(F.col("h"), *(F.lit(float(v)) for v in (10, 20, 100, 40))))
    return _quads(spark, d).select("reg_id", box.alias("b")).select("reg_id", *(F.col(f"b.{c}").cast(BIG).alias(c) for c in "xywh"))


@query(f"SELECT reg_id, round(abs((q[1][1]*q[2][2]-q[2][1]*q[1][2])+(q[2][1]*q[3][2]-q[3][1]*q[2][2])+(q[3][1]*q[4][2]-q[4][1]*q[3][2])+(q[4][1]*q[1][2]-q[1][1]*q[4][2]))/2, 4) AS area FROM ({DETS})")
def quad_area(spark, d):
    return _quads(spark, d).select("reg_id", F.round(G.polygon_area(F.col("q")), 4).alias("area"))


@query()
def quad_overlap(spark, d):
    """The share of each quadrilateral that lies on its canvas."""
    rows = G.overlap_shares(_quads(spark, d), "q", "canvas_width", "canvas_height")
    return rows.select("reg_id", r6("overlap").alias("share"))


@query(f"SELECT reg_id, h[1][1] * (canvas_width::DOUBLE / target_width) AS a, h[2][3] * 0.5::DOUBLE + 0 AS f, h[3][3] AS i FROM ({DETS}) WHERE target_width > 0")
def full_scale(spark, d):
    scaled = G.scaled_homography(F.col("h"), F.col("canvas_width") / F.col("target_width"), F.lit(0.5))
    rows = _quads(spark, d).where("target_width > 0").select("reg_id", scaled.alias("s"))
    return rows.select("reg_id", G.cell(F.col("s"), 0, 0).alias("a"), (G.cell(F.col("s"), 1, 2) + 0).alias("f"), G.cell(F.col("s"), 2, 2).alias("i"))


BOX = "SELECT DISTINCT proposal_id, derivative_xywh AS b, yale_xywh AS y, word_relative_xywh AS r FROM proposals WHERE derivative_xywh IS NOT NULL"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proposals").select("proposal_id", F.col("derivative_xywh").alias("b"), F.col("yale_xywh").alias("y"), F.col("word_relative_xywh").alias("r")).where("b IS NOT NULL").distinct()


@query(f"SELECT proposal_id, greatest(0, b.x - 5)::BIGINT AS x, greatest(0, b.y - 5)::BIGINT AS y, greatest(0, least(1000, b.x + b.w + 5) - greatest(0, b.x - 5))::BIGINT AS w, greatest(0, least(700, b.y + b.h + 5) - greatest(0, b.y - 5))::BIGINT AS h FROM ({BOX})")
def box_clamp(spark, d):
    b = F.col("b")
    box = G.clamped_box(b.x, b.y, b.w, b.h, F.lit(1000), F.lit(700), 5)
    return _boxes(spark, d).select("proposal_id", box.alias("c")).select("proposal_id", *(F.col(f"c.{c}").cast(BIG).alias(c) for c in "xywh"))


@query(f"SELECT proposal_id, greatest(1, round_even(r.w * (y.w / greatest(1, b.w)), 0))::BIGINT AS w, (y.x + round_even(r.x * (y.w / greatest(1, b.w)), 0))::BIGINT AS x FROM ({BOX}) WHERE r IS NOT NULL AND y IS NOT NULL")
def full_coordinates(spark, d):
    rows = _boxes(spark, d).where("r IS NOT NULL AND y IS NOT NULL").withColumn("full", proposals.in_page(F.col("r"), F.col("b"), F.col("y"))[1])
    return rows.select("proposal_id", F.col("full.w").cast(BIG).alias("w"), F.col("full.x").cast(BIG).alias("x"))


# words and proposals


@query("SELECT p_partkey, w.s AS share, x FROM part, (VALUES (38), (62)) w(s), LATERAL (SELECT greatest(8, least(p_size + 40, round_even((p_size + 40) * (w.s / 100.0)::DOUBLE, 0)::INT)) AS ww) a, LATERAL (SELECT greatest(4, round_even(ww * 0.6::DOUBLE, 0)::INT) AS step, greatest(0, p_size + 40 - ww) AS last) b, LATERAL (SELECT DISTINCT unnest(list_slice(list_sort(list_distinct(list_append(generate_series(0, last, step), last))), 1, 4)) AS x) c")
def sliding_windows(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 40).alias("width"))
    boxes = proposals.window_boxes(F.col("width"), F.lit(20), CURRENT_LIMITS)
    narrow = F.greatest(F.lit(8), F.least(F.col("width"), F.rint(F.col("width") * 0.38).cast("int")))
    found = rows.select("p_partkey", "width", narrow.alias("narrow"), F.explode(boxes).alias("b"))
    return found.select("p_partkey", F.when(F.col("b.w") == F.col("narrow"), 38).otherwise(62).alias("share"), F.col("b.x").cast(BIG).alias("x"))


PARTS = f"""p AS (SELECT DISTINCT {folio_form_sql('folio')} AS folio, source_index, word_relative_xywh AS b FROM proposals WHERE lower(proposal_type) = 'component' AND word_relative_xywh IS NOT NULL AND source_index IS NOT NULL),
 o AS (SELECT folio, source_index, b.x, b.y, b.w, b.h, row_number() OVER w AS k, count(*) OVER (PARTITION BY folio, source_index) AS m, greatest(2, trunc(median(b.h) OVER (PARTITION BY folio, source_index) * 0.2)) AS gap FROM p WHERE folio IS NOT NULL WINDOW w AS (PARTITION BY folio, source_index ORDER BY b.x, b.y, b.w, b.h))"""


@query(f"""WITH RECURSIVE {PARTS},
 r AS (SELECT folio, source_index, k, m, x AS x0, y AS y0, x + w AS x1, y + h AS y1, NULL::INT[] AS closed FROM o WHERE k = 1
  UNION ALL SELECT o.folio, o.source_index, o.k, o.m, CASE WHEN j THEN least(x0, s.x) ELSE s.x END, CASE WHEN j THEN least(y0, s.y) ELSE s.y END, CASE WHEN j THEN greatest(x1, s.x + s.w) ELSE s.x + s.w END, CASE WHEN j THEN greatest(y1, s.y + s.h) ELSE s.y + s.h END, CASE WHEN NOT j THEN [x0, y0, x1 - x0, y1 - y0] END
  FROM (SELECT r.*, o.x, o.y, o.w, o.h, o.k AS k2, x - x1 <= gap AND greatest(0, least(y1, y + h) - greatest(y0, y)) / greatest(1, least(y1 - y0, h)) >= 0.2 AS j FROM r JOIN o ON o.folio = r.folio AND o.source_index = r.source_index AND o.k = r.k + 1) s JOIN o ON o.folio = s.folio AND o.source_index = s.source_index AND o.k = k2),
 d AS (SELECT folio, source_index, k - 1 AS k, closed AS v FROM r WHERE closed IS NOT NULL UNION ALL SELECT folio, source_index, k, [x0, y0, x1 - x0, y1 - y0] FROM r WHERE k = m),
 f AS (SELECT d.* FROM d ANTI JOIN (SELECT folio, source_index, [x, y, w, h] AS v FROM o) c ON d.folio = c.folio AND d.source_index = c.source_index AND d.v = c.v WHERE v[3] * v[4] >= 32)
 SELECT folio, source_index, n, v[1] AS x, v[2] AS y, v[3] AS w, v[4] AS h FROM (SELECT *, row_number() OVER (PARTITION BY folio, source_index ORDER BY k) - 1 AS n FROM f) WHERE n < 6""")
def box_merge(spark, d):
    """Merged neighbours among the components of each word."""
    rows = table(spark, d, "proposals").where("lower(proposal_type) = 'component' AND word_relative_xywh IS NOT NULL").select(folio_form(F.col("folio")).alias("folio"), "source_index", F.col("word_relative_xywh").alias("b")).where("folio IS NOT NULL AND source_index IS NOT NULL")
    words = rows.distinct().groupBy("folio", "source_index").agg(F.collect_list("b").alias("parts"))
    return words.select("folio", "source_index", F.posexplode(proposals.merged_boxes(F.col("parts"))).alias("n", "box")).select("folio", "source_index", F.col("n").cast(BIG).alias("n"), "box.*")


@query(f"""WITH RECURSIVE b AS (SELECT folio, source_index, min(v.x)::DOUBLE AS x, min(v.y)::DOUBLE AS y, max(v.h)::DOUBLE AS h FROM (SELECT {folio_form_sql('folio')} AS folio, source_index, derivative_xywh AS v FROM proposals) WHERE folio IS NOT NULL AND source_index IS NOT NULL AND v IS NOT NULL GROUP BY folio, source_index),
 o AS (SELECT folio, source_index, x, y + h / 2 AS c, row_number() OVER (PARTITION BY folio ORDER BY y + h / 2, x, source_index) AS k, greatest(8, 0.65::DOUBLE * median(h) OVER (PARTITION BY folio)) AS reach FROM b),
 r AS (SELECT folio, k, 0 AS line_index, [c] AS run FROM o WHERE k = 1
  UNION ALL SELECT folio, k, CASE WHEN far THEN line_index + 1 ELSE line_index END, CASE WHEN far THEN [c] ELSE list_append(run, c) END FROM (SELECT o.folio, o.k, o.c, r.line_index, r.run, o.c - list_aggregate(r.run, 'median') > o.reach AS far FROM r JOIN o ON o.folio = r.folio AND o.k = r.k + 1))
 SELECT folio, source_index, line_index, row_number() OVER w - 1 AS token_index, count(*) OVER l AS line_length, row_number() OVER w = 1 AS line_start, row_number() OVER w = count(*) OVER l AS line_end
 FROM o JOIN r USING (folio, k) WINDOW w AS (PARTITION BY folio, line_index ORDER BY x, c, source_index), l AS (PARTITION BY folio, line_index)""")
def line_inference(spark, d):
    """The lines of each page, from the words' boxes."""
    rows = table(spark, d, "proposals").select(folio_form(F.col("folio")).alias("folio"), "source_index", F.col("derivative_xywh").alias("b")).where("folio IS NOT NULL AND source_index IS NOT NULL AND b IS NOT NULL")
    boxes = rows.groupBy("folio", "source_index").agg(F.min("b.x").alias("x"), F.min("b.y").alias("y"), F.max("b.w").alias("w"), F.max("b.h").alias("h"))
    return layout.infer_lines(boxes).select("folio", "source_index", "line_index", F.col("token_index").cast(BIG).alias("token_index"), F.col("line_length").cast(BIG).alias("line_length"), "line_start", "line_end")


@query("SELECT count(*) FILTER (b.w >= 8 AND b.h >= 8 AND b.w * b.h >= 80) AS words_kept, count(*) FILTER (b.w >= 4 AND b.h >= 4 AND b.w * b.h >= 24 AND i BETWEEN 0.005 AND 0.92 AND NOT isnan(i)) AS proposals_kept FROM (SELECT DISTINCT proposal_id, derivative_xywh AS b, ink_fraction AS i FROM proposals)")
def size_filter(spark, d):
    rows = table(spark, d, "proposals").select("proposal_id", F.col("derivative_xywh").alias("b"), F.col("ink_fraction").alias("i")).distinct()
    b = F.col("b")
    return rows.agg(F.count_if((b.w >= 8) & (b.h >= 8) & (b.w * b.h >= 80)).alias("words_kept"), F.count_if((b.w >= 4) & (b.h >= 4) & (b.w * b.h >= 24) & proposals.keeps_ink(F.col("i"))).alias("proposals_kept"))


@query("WITH p AS (SELECT DISTINCT proposal_id, folio, lower(trim(proposal_type, ' ')) AS t, word_relative_xywh AS b FROM proposals WHERE folio IS NOT NULL AND word_relative_xywh IS NOT NULL), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY folio, t, b ORDER BY proposal_id) = 1) SELECT folio, proposal_id, row_number() OVER (PARTITION BY folio ORDER BY proposal_id, t) - 1 AS n FROM f")
def dedup_first(spark, d):
    rows = table(spark, d, "proposals").select("proposal_id", "folio", F.lower(F.trim("proposal_type")).alias("t"), F.col("word_relative_xywh").alias("b")).where("folio IS NOT NULL AND b IS NOT NULL").distinct()
    return proposals.first_of_each(rows, ["folio", "t", "b"], ["proposal_id", "t"], "n").select("folio", "proposal_id", F.col("n").cast(BIG).alias("n"))


@query(f"WITH c AS (SELECT folio, arg_max(coalesce(site_class, ''), ord) AS site_class FROM (SELECT {folio_form_sql('folio')} AS folio, site_class, ord FROM folio_inventory) WHERE folio IS NOT NULL AND ord IS NOT NULL GROUP BY folio), p AS (SELECT DISTINCT {folio_form_sql('folio')} AS folio FROM proposals) SELECT coalesce(site_class, '') AS site_class, count(*) AS folios FROM p LEFT JOIN c USING (folio) WHERE p.folio IS NOT NULL GROUP BY 1")
def left_lookup_default(spark, d):
    entries = table(spark, d, "folio_inventory").select(folio_form(F.col("folio")).alias("folio"), F.coalesce("site_class", F.lit("")).alias("site_class"), "ord").where("ord IS NOT NULL")
    classes = readers.inventory_classes(entries).select("folio", "site_class")
    folios = table(spark, d, "proposals").select(folio_form(F.col("folio")).alias("folio")).where("folio IS NOT NULL").distinct()
    return relational.lookup(folios, classes, ["folio"], "site_class", F.lit("")).groupBy("site_class").agg(F.count("*").alias("folios"))


# samples

BYTE = "('0x' || substr(sha256('408:' || folio || ':' || source_index || ':' || proposal_index), 1, 2))::INT"


@query(f"SELECT DISTINCT proposal_id FROM proposals WHERE folio IS NOT NULL AND source_index IS NOT NULL AND proposal_index IS NOT NULL AND {BYTE} < 3")
def hash_sample(spark, d):
    rows = table(spark, d, "proposals").where("folio IS NOT NULL AND source_index IS NOT NULL AND proposal_index IS NOT NULL")
    return byte_sample(rows, ["folio", "source_index", "proposal_index"], 3).select("proposal_id").distinct()


@query("SELECT pair, a, b FROM (VALUES " + ", ".join(f"({p}, {a}, {b})" for p, a, b in leaf_pairs()) + ") t(pair, a, b) WHERE ('0x' || substr(sha256('408:' || pair), 1, 2))::INT < 52")
def holdout_split(spark, d):
    return spark.createDataFrame(leaf_pairs(), "pair int, a int, b int").where(held_out(F.col("pair")))


@query("WITH p AS (SELECT pair, unnest([a, b]) AS leaf FROM (VALUES " + ", ".join(f"({p}, {a}, {b})" for p, a, b in leaf_pairs()) + f") t(pair, a, b)), f AS (SELECT DISTINCT {folio_form_sql('folio')} AS folio FROM proposals) SELECT pair, count(*) AS folios FROM f JOIN p ON leaf = TRY_CAST(regexp_extract(folio, '^f([0-9]+)', 1) AS INT) GROUP BY pair")
def pair_explode(spark, d):
    pairs = spark.createDataFrame(leaf_pairs(), "pair int, a int, b int").select("pair", F.explode(F.array("a", "b")).alias("leaf"))
    folios = table(spark, d, "proposals").select(folio_form(F.col("folio")).alias("folio")).where("folio IS NOT NULL").distinct().withColumn("leaf", F.regexp_extract("folio", "^f([0-9]+)", 1).try_cast("int"))
    return folios.join(F.broadcast(pairs), "leaf").groupBy("pair").agg(F.count("*").alias("folios"))


@query(f"WITH s AS (SELECT count(DISTINCT coalesce(source, '')) AS n FROM documents), r AS (SELECT doc_id, {position_sql('doc_id')} AS h, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY {position_sql('doc_id')}, doc_id) AS k FROM documents) SELECT doc_id FROM (SELECT doc_id, h FROM r, s WHERE k <= greatest(20, 400 // n)) ORDER BY h, doc_id LIMIT 400")
def stratified_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return stratified_cap(rows, "source", "doc_id", 400).select("doc_id")


# frequencies and sets


@query("SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) QUALIFY rank <= 3")
def topn_common(spark, d):
    return relational.most_common(table(spark, d, "events"), "user_id", "event_type", 3).withColumn("rank", F.col("rank").cast(BIG))


PER_LABEL = f"SELECT lower(trim(eva, ' ')) AS eva, count(DISTINCT proposal_id) AS n, count(DISTINCT {folio_form_sql('folio')}) AS folios FROM proposals WHERE eva IS NOT NULL GROUP BY 1"


def _per_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "proposals").where("eva IS NOT NULL").select("proposal_id", F.lower(F.trim("eva")).alias("eva"), folio_form(F.col("folio")).alias("folio"))
    return rows.groupBy("eva").agg(F.count_distinct("proposal_id").alias("n"), F.count_distinct("folio").alias("folios"))


@query(PER_LABEL)
def distinct_per_group(spark, d):
    return _per_label(spark, d)


@query(f"SELECT * FROM ({PER_LABEL}) WHERE n >= 20 AND folios >= 3")
def class_floor(spark, d):
    return _per_label(spark, d).where("n >= 20 AND folios >= 3")


@query("SELECT t AS proposal_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) = max(count(*)) OVER () AS majority FROM (SELECT DISTINCT proposal_id, lower(trim(proposal_type, ' ')) AS t FROM proposals WHERE proposal_type IS NOT NULL) GROUP BY t")
def label_freq(spark, d):
    counts = table(spark, d, "proposals").where("proposal_type IS NOT NULL").select("proposal_id", F.lower(F.trim("proposal_type")).alias("proposal_type")).distinct().groupBy("proposal_type").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # a handful of types
    return counts.select("proposal_type", "n", r6(F.col("n") / F.sum("n").over(everything)).alias("share"), (F.col("n") == F.max("n").over(everything)).alias("majority"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z]+'), lambda w: w <> ''))"


@query(f"WITH f AS (SELECT folio, arg_min(text, doc_id) AS other FROM documents WHERE folio IS NOT NULL AND text IS NOT NULL GROUP BY folio), s AS (SELECT doc_id, {WORDS.format('text')} AS a, {WORDS.format('other')} AS b FROM documents JOIN f USING (folio)) SELECT doc_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard FROM s")
def set_jaccard(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "folio", "text")
    first = rows.where("folio IS NOT NULL AND text IS NOT NULL").groupBy("folio").agg(F.min_by("text", "doc_id").alias("other"))
    return relational.token_jaccard(rows.join(first, "folio"), "doc_id", "text", "other").withColumn("jaccard", r6("jaccard"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_of_text(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"SELECT DISTINCT {folio_form_sql('folio')} AS folio FROM folio_inventory WHERE {folio_form_sql('folio')} IS NOT NULL EXCEPT SELECT {folio_form_sql('folio')} FROM registrations WHERE accepted")
def except_members(spark, d):
    """The folios of the inventory of which no registration was accepted."""
    form = folio_form(F.col("folio")).alias("folio")
    listed = table(spark, d, "folio_inventory").select(form).where("folio IS NOT NULL")
    return relational_except(listed, table(spark, d, "registrations").where("accepted").select(form).where("folio IS NOT NULL"))


def relational_except(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, left.columns, "left_anti")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def semi_filter(spark, d):
    kept = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(kept, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


TRIED = f"tr AS (SELECT DISTINCT {folio_form_sql('folio')} AS folio, candidate_index AS index FROM registrations WHERE candidate_index IS NOT NULL)"


@query(f"WITH {TOKENS}, {KEYS}, {TRIED}, nr AS (SELECT folio, index FROM (SELECT folio, unnest([n - 1, n, n + 1]) AS m FROM ky) JOIN to_ ON token IN (m || 'r', m || 'v')) SELECT DISTINCT folio, index FROM nr ANTI JOIN tr USING (folio, index)")
def anti_fallback(spark, d):
    """The near candidates of a second wave that the first hasn't tried."""
    wanted = registration.candidates(table(spark, d, "folio_inventory").select("folio"), _canvases(spark, d), broad=True)
    tried = table(spark, d, "registrations").select(folio_form(F.col("folio")).alias("folio"), F.col("candidate_index").alias("index")).where("folio IS NOT NULL AND index IS NOT NULL")
    return readers.missing(wanted, tried, ["folio", "index"])


@query("SELECT c_custkey AS k, 'first' AS wave FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, NULL FROM supplier")
def union_fallback(spark, d):
    c = table(spark, d, "customer")
    first = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.lit("first").alias("wave"))
    second = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("second").alias("wave"))
    return first.unionByName(second).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def three_way_lookup(spark, d):
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# sequences


@query("SELECT event_id, lag(event_type) OVER w AS prev_type, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def seq_context(spark, d):
    rows = layout.neighbours_in_line(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("event_id", F.col("prev_event_type").alias("prev_type"), F.col("next_event_type").alias("next_type"))


@query("SELECT event_id, row_number() OVER w - 1 AS token_index, count(*) OVER (PARTITION BY user_id) AS line_length, row_number() OVER w = 1 AS line_start, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS line_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def seq_position(spark, d):
    rows = layout.places(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", F.col("token_index").cast(BIG).alias("token_index"), F.col("line_length").cast(BIG).alias("line_length"), "line_start", "line_end")


@query("SELECT user_id, day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)")
def running_totals(spark, d):
    days = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("so_far", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("SELECT event_id, sum(o) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT event_id, user_id, value, (coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY value), 0) > 1)::INT AS o FROM events)")
def gap_sessions(spark, d):
    return layout.gap_sessions(table(spark, d, "events"), ["user_id"], "value", 1.0).select("event_id", "session")


# statistics


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_quantity) AS median_quantity, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(stddev_pop(l_discount), 6) AS sd, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY ALL")
def quantile_profile(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.median("l_quantity").alias("median_quantity"), r6(F.percentile("l_extendedprice", 0.05)).alias("p05"), r6(F.percentile("l_extendedprice", 0.95)).alias("p95"), r6(F.stddev_pop("l_discount")).alias("sd"), r6(F.avg("l_tax")).alias("mean_tax"))


@query("WITH t AS (SELECT user_id, (count(*) FILTER (event_type = 'purchase') + 1) / (count(*) * 8.0) AS p FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS rank, count(*) OVER () AS m FROM t), c AS (SELECT max(rank) FILTER (p <= 0.05 * rank / m) AS last FROM r) SELECT user_id, round(p, 6) AS p, rank, coalesce(rank <= last, false) AS significant FROM r, c")
def bh_fdr(spark, d):
    tests = table(spark, d, "events").groupBy("user_id").agg(((F.count_if(F.col("event_type") == "purchase") + 1) / (F.count("*") * 8.0)).alias("p"))
    return stats.benjamini_hochberg(tests, "p").select("user_id", r6("p").alias("p"), F.col("rank").cast(BIG).alias("rank"), "significant")


DRAW = position_sql("draw", "g", "s")


@query(f"""WITH b AS (SELECT event_type AS g, user_id % 50 AS s, value > 10 AS side, event_id % 3 = 0 AS flag FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
 c AS (SELECT g, s, count(*) AS n, count(*) FILTER (side) AS k, count(*) FILTER (flag) AS f, count(*) FILTER (side AND flag) AS x FROM b GROUP BY g, s),
 h AS (SELECT g, s, t, lgamma(f + 1) - lgamma(t + 1) - lgamma(f - t + 1) + lgamma(n - f + 1) - lgamma(k - t + 1) - lgamma(n - f - k + t + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) AS l FROM c, LATERAL (SELECT unnest(generate_series(greatest(0, f + k - n), least(f, k))) AS t) q),
 d AS (SELECT g, s, t, sum(exp(l)) OVER (PARTITION BY g, s ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM h),
 u AS (SELECT g, s, draw, {DRAW} / {float(SPAN)} AS u FROM c, generate_series(1, 200) q(draw)),
 z AS (SELECT u.g, draw, u.s, min(t) AS t FROM u JOIN d ON u.g = d.g AND u.s = d.s AND upto > u GROUP BY ALL), w AS (SELECT g, draw, sum(t) AS x FROM z GROUP BY g, draw),
 a AS (SELECT g, sum(n) AS n, sum(k) AS k, sum(f) AS f, sum(x) AS seen FROM c GROUP BY g),
 r AS (SELECT a.g, n, abs(x / k - (f - x) / (n - k)) AS gap, abs(seen / k - (f - seen) / (n - k)) AS observed FROM w JOIN a ON w.g = a.g)
 SELECT g AS event_type, any_value(n)::BIGINT AS n, round(any_value(observed), 6) AS observed, round((1 + count(*) FILTER (gap >= observed - 1e-12)) / (1 + count(*)), 6) AS p FROM r GROUP BY g""")
def permutation_test(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 50).alias("s"), (F.col("value") > 10).alias("side"), (F.col("event_id") % 3 == 0).alias("flag")).where("event_type IS NOT NULL")
    return stats.permutation_test(rows, "event_type", "side", "flag", ["s"]).select("event_type", "n", r6("observed").alias("observed"), r6("p").alias("p"))


# JSON, documents, sinks


@query("SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query()
def manifest_canvases(spark, d):
    """The canvases of the plain form, with the addresses of their derivatives."""
    return readers.manifest_canvases(table(spark, d, "manifests").select("raw_id", "manifest").distinct()).distinct()


@query("SELECT doc_id, length(replace(base64(encode(text)), chr(10), '')) AS chars, ceil(length(base64(encode(text))) / 1000)::BIGINT AS chunks, sha256(substr(base64(encode(text)), 1, 1000)) AS first_hash FROM documents WHERE text IS NOT NULL AND text <> ''")
def b64_chunks(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", F.col("text").cast("binary").alias("data"))
    parts = sinks.base64_chunks(rows, "doc_id", "data", 1000)
    return parts.groupBy("doc_id").agg(F.sum(F.length("part")).alias("chars"), F.max("chunks").cast(BIG).alias("chunks"), F.sha2(F.max(F.when(F.col("chunk") == 0, F.col("part"))), 256).alias("first_hash"))


@query("SELECT cluster_id, size, len(top_folios) AS shown FROM earlier_clusters WHERE size IS NOT NULL GROUP BY ALL")
def drop_field(spark, d):
    rows = table(spark, d, "earlier_clusters").where("size IS NOT NULL").select("cluster_id", F.struct("size", F.lit(1).alias("centroid"), "top_folios").alias("c"))
    return rows.select("cluster_id", F.col("c").dropFields("centroid").alias("c")).select("cluster_id", "c.size", F.when(F.col("c.top_folios").isNotNull(), F.size("c.top_folios")).cast(BIG).alias("shown")).distinct()


# extensions: relational breadth and event windows


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, d):
    rows = windows.windowed(table(spark, d, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR) IS NOT TRUE AS o FROM events), s AS (SELECT user_id, ts, sum(o::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    return windows.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
