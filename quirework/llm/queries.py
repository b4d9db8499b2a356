"""The queries for training data, and their equivalents in DuckDB's SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.folio import folio_form, folio_form_sql
from quirework.functions.hashing import SPAN, position_sql
from quirework.llm import components, languages, mixing, neighbours, sampling, spectral, splits, tokens, topn
from quirework.session import table

PROPOSAL_RATE, LOOSE_RATE, FOLIO_RATE = 0.1, 0.05, 0.25


def p1_proposals(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the proposals of each folio; a twentieth of those that lie on none."""
    lies = sampling.first_delivery(table(spark, d, "proposals"), "proposal_id", folio_form(F.col("folio")), "ingested_at")
    rates = spark.createDataFrame([(sampling.NO_STRATUM, LOOSE_RATE)], "stratum string, rate double")
    return sampling.hash_sample(lies, PROPOSAL_RATE, rates).select(F.col("key").alias("proposal_id"), F.col("stratum").alias("folio"))


def p1_folios(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the folios that carry proposals."""
    folios = table(spark, d, "proposals").select(folio_form(F.col("folio")).alias("key")).where("key IS NOT NULL").distinct()
    return sampling.hash_sample(folios.withColumn("stratum", F.lit("folio")), FOLIO_RATE, salt="folio").select(F.col("key").alias("folio"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_candidates(table(spark, d, "registrations")).select("folio", "candidate_index")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_candidates(table(spark, d, "registrations")).withColumn("rank", F.col("rank").cast("bigint"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.hook_components(table(spark, d, "mutual_edges"), "id_i", "id_j").select(F.col("id").alias("proposal_id"), "group_id")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("size"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "proposal_vectors"), 5, 0.82).withColumn("rank", F.col("rank").cast("bigint"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(neighbours.nearest(table(spark, d, "proposal_vectors"), 5, 0.82))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.leaf_groups(table(spark, d, "proposals"), table(spark, d, "bifolios")).select("folio", "group_leaf")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.proposal_splits(table(spark, d, "proposals"), table(spark, d, "bifolios"), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, overall (proposal_type '*') and for each type."""
    kind = F.coalesce(F.lower(F.trim("proposal_type")), F.lit(""))
    types = sampling.first_delivery(table(spark, d, "proposals"), "proposal_id", kind, "ingested_at").select(F.col("key").alias("proposal_id"), F.col("stratum").alias("proposal_type"))
    rows = p5_split(spark, d).join(types, "proposal_id").select("split_name", F.explode(F.array(F.lit("*"), "proposal_type")).alias("proposal_type"))
    counts = rows.groupBy("proposal_type", "split_name").agg(F.count("*").alias("n"))
    whole = counts.groupBy("proposal_type").agg(F.sum("n").alias("all_n"))
    return counts.join(whole, "proposal_type").select("proposal_type", "split_name", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spectral.closed_groups(table(spark, d, "proposal_vectors"))


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spectral.described(table(spark, d, "proposal_vectors"), folio=folio_form(F.col("folio")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(p8_ids(spark, d))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The size of the corpus in tokens of each tokenizer."""
    documents = table(spark, d, "documents")
    counts = None
    for name in (*tokens.BYTE_LEVEL, "word_bpe_49k", "piece_bpe_32k"):
        one = tokens.token_counts(documents, name).agg(F.count("*").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.lit(name).alias("tokenizer"), "documents", "tokens")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    mix, rates = mixing.mixed(mixing.sized(table(spark, d, "documents")), targets)
    return mixing.mix_report(mix, rates, targets)


def _model(spark: SparkSession, d: str):
    return languages.train(table(spark, d, "lang_samples"), table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(table(spark, d, "documents"), _model(spark, d))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_segments(table(spark, d, "documents").select("doc_id", "text"), _model(spark, d))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language with its confidence, and the number of its segments."""
    return _read(spark, d).select("doc_id", "language", "confidence", F.size("segments").cast("bigint").alias("segments"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of each text, in its place, with its language and confidence."""
    return _read(spark, d).select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


QUERIES = {
    "p1_proposals": p1_proposals,
    "p1_folios": p1_folios,
    "p2_found": p2_found,
    "p2_ranked": p2_ranked,
    "p3_found": p3_found,
    "p3_sizes": p3_sizes,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p5_shares": p5_shares,
    "p7_found": p7_found,
    "p7_clusters": p7_clusters,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p8_tokens": p8_tokens,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_segments": p10_segments,
}

_FIRST = f"""SELECT proposal_id, coalesce({folio_form_sql('folio')}, '') AS folio FROM proposals WHERE proposal_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY ingested_at NULLS LAST, coalesce({folio_form_sql('folio')}, '')) = 1"""
_RANKED = f"""WITH u AS (SELECT {folio_form_sql('folio')} AS folio, candidate_index, inliers, inlier_ratio, median_reprojection_px FROM registrations
  WHERE error IS NULL AND inliers >= 0 AND inliers <= matches AND inlier_ratio BETWEEN 0 AND 1 AND isfinite(median_reprojection_px) AND median_reprojection_px >= 0 AND candidate_index IS NOT NULL),
 b AS (SELECT * FROM u WHERE folio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folio, candidate_index ORDER BY inliers DESC, inlier_ratio DESC, median_reprojection_px) = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY folio ORDER BY inliers DESC, inlier_ratio DESC, median_reprojection_px, candidate_index) AS rank FROM b)
 SELECT {{}} FROM r WHERE rank <= 3"""
_EDGES = """e AS (SELECT DISTINCT a, b FROM (SELECT {0} AS a, {1} AS b FROM {2} UNION ALL SELECT {1}, {0} FROM {2}) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
 w(id, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.m FROM w JOIN e ON w.id = e.a WHERE w.m < e.b),
 g AS (SELECT id, min(m) AS group_id FROM w GROUP BY id)"""
_GROUPS = "WITH RECURSIVE " + _EDGES.format("id_i", "id_j", "mutual_edges")
# The exact answers; the index is approximate, but finds all of them at the scale of the comparison.
_VECTORS = """WITH v AS (SELECT vec_id, any_value(vec::DOUBLE[]) AS v FROM proposal_vectors WHERE vec_id IS NOT NULL AND vec IS NOT NULL AND len(vec) = 64
  AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY vec_id),
 s AS (SELECT a.vec_id AS id, b.vec_id AS near, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, near) AS rank FROM s WHERE cosine >= 0.82),
 g AS (SELECT id, list_sort(list_append(list(near), id)) AS m FROM n GROUP BY id), k AS (SELECT m, count(*) AS c FROM g GROUP BY m)"""

_PLACED = f"""WITH RECURSIVE {_EDGES.format("leaf_a", "leaf_b", "bifolios")},
 l AS (SELECT proposal_id, coalesce({folio_form_sql('folio')}, CASE WHEN trim(folio, ' ') <> '' THEN '?' || lower(trim(folio, ' ')) END, '') AS stratum FROM proposals WHERE proposal_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY ingested_at NULLS LAST, stratum) = 1),
 k AS (SELECT proposal_id, CASE WHEN stratum = '' THEN 'proposal:' || proposal_id WHEN stratum LIKE '?%' THEN 'name:' || stratum ELSE 'leaf:' || coalesce(group_id, TRY_CAST(regexp_extract(stratum, '^f([0-9]+)', 1) AS INT)) END AS unit FROM l LEFT JOIN g ON id = CASE WHEN stratum LIKE 'f%' THEN TRY_CAST(regexp_extract(stratum, '^f([0-9]+)', 1) AS INT) END),
 u AS (SELECT unit, count(*) AS n, {position_sql("unit", salt="split")} AS spot FROM k GROUP BY unit), a AS (SELECT sum(n) AS total FROM u),
 m AS (SELECT unit, (sum(n) OVER (ORDER BY n > total * 0.02 DESC, CASE WHEN n > total * 0.02 THEN -n ELSE 0 END, spot, unit ROWS UNBOUNDED PRECEDING) - n / 2) / total AS middle FROM u, a),
 t AS (SELECT split_name, row_number() OVER w AS i, sum(share) OVER w / sum(share) OVER () AS upto, count(*) OVER () AS c FROM split_targets WHERE share > 0 WINDOW w AS (ORDER BY share DESC, split_name ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT unit, arg_min(split_name, i) AS split_name FROM m JOIN t ON middle < upto OR i = c GROUP BY unit)"""
_SHARES = f""", y AS (SELECT proposal_id, coalesce(lower(trim(proposal_type, ' ')), '') AS proposal_type FROM proposals WHERE proposal_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY ingested_at NULLS LAST, coalesce(lower(trim(proposal_type, ' ')), '')) = 1),
 q AS (SELECT split_name, unnest(['*', proposal_type]) AS proposal_type FROM k JOIN s USING (unit) JOIN y USING (proposal_id))
 SELECT proposal_type, split_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY proposal_type), 6) AS share FROM q GROUP BY proposal_type, split_name"""

ORACLE = {
    "p5_split": f"{_PLACED} SELECT proposal_id, unit, split_name FROM k JOIN s USING (unit)",
    "p5_shares": _PLACED + _SHARES,
    "p4_nearest": f"{_VECTORS} SELECT id, near, cosine, rank FROM n WHERE rank <= 5",
    "p4_found": f"{_VECTORS} SELECT DISTINCT least(id, near) AS vec_id_a, greatest(id, near) AS vec_id_b FROM n WHERE rank <= 5",
    "p7_found": f"{_VECTORS} SELECT id AS vec_id, m[1] AS cluster_key FROM g JOIN k USING (m) WHERE c = len(m) AND c >= 5",
    "p1_proposals": f"SELECT proposal_id, folio FROM ({_FIRST}) WHERE {position_sql('proposal_id')} < CASE WHEN folio = '' THEN {int(LOOSE_RATE * SPAN)} ELSE {int(PROPOSAL_RATE * SPAN)} END",
    "p1_folios": f"SELECT DISTINCT folio FROM (SELECT {folio_form_sql('folio')} AS folio FROM proposals) WHERE {position_sql('folio', salt='folio')} < {int(FOLIO_RATE * SPAN)}",
    "p2_found": _RANKED.format("folio, candidate_index"),
    "p2_ranked": _RANKED.format("folio, candidate_index, inliers, inlier_ratio, median_reprojection_px, rank"),
    "p3_found": f"{_GROUPS} SELECT id AS proposal_id, group_id FROM g",
    "p3_sizes": f"{_GROUPS} SELECT group_id, count(*) AS size FROM g GROUP BY group_id",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": "WITH RECURSIVE "
    + _EDGES.format("leaf_a", "leaf_b", "bifolios")
    + f""", f AS (SELECT DISTINCT folio, TRY_CAST(regexp_extract(folio, '^f([0-9]+)', 1) AS INT) AS leaf FROM (SELECT {folio_form_sql('folio')} AS folio FROM proposals) WHERE folio IS NOT NULL)
 SELECT folio, coalesce(group_id, leaf) AS group_leaf FROM f LEFT JOIN g ON id = leaf WHERE leaf IS NOT NULL""",
}
