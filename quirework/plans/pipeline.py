"""The whole run as one plan: registration, words, proposals, vectors, clusters, audits, verdict."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import CURRENT_LIMITS, MOST_DISCOVERED, SMOKE_FOLIOS, ProposalLimits, leaf_pairs
from quirework.functions.text import leaf_base
from quirework.functions.vectors import dot
from quirework.operators import audit, imaging, layout, proposals, registration, stats
from quirework.operators.knn import exact_knn
from quirework.operators.sampling import byte_sample, display_picks
from quirework.plans.lineage import cut
from quirework.sources import sinks


@dataclass
class Inputs:
    """What a run reads: inventory (folio, site_class, ord), canvases, labels and boxes of words, images by canvas.

    attempt matches page images with canvases: it turns (folio, index) into registrations; model embeds crops, and large,
    if given, once more for the agreement of two models. mode "smoke" takes a few named pages only.
    """

    inventory: DataFrame
    canvases: DataFrame
    labels: DataFrame
    boxes: DataFrame
    images: DataFrame
    attempt: Callable[[DataFrame], DataFrame]
    model: Column | imaging.Embedder | None = None
    rules: DataFrame | None = None
    limits: ProposalLimits = field(default_factory=lambda: CURRENT_LIMITS)
    large: imaging.Embedder | None = None
    mode: str = "full"
    most_discovered: int = MOST_DISCOVERED

    def folios(self) -> DataFrame:
        """The folios of the inventory, once each; of these the named ones in smoke mode."""
        every = self.inventory.select("folio").where("folio IS NOT NULL").distinct()
        return every.where(F.col("folio").isin(*SMOKE_FOLIOS)) if self.mode == "smoke" else every


def registered(given: Inputs) -> DataFrame:
    """The selected registration of each folio, with the rules applied."""
    chosen = cut(registration.register(given.folios(), given.canvases, given.attempt)[1])
    return registration.adjudicated(chosen, given.rules) if given.rules is not None else chosen


def registration_report(given: Inputs) -> DataFrame:
    """(value): the report of a run that stops before any image is embedded."""
    return sinks.summary_line(registration.report(registered(given)), "REGISTRATION_REPORT=")


def words(given: Inputs, chosen: DataFrame) -> DataFrame:
    return layout.word_records(given.boxes, given.labels, chosen, given.inventory)


def proposal_crops(given: Inputs, word_rows: DataFrame) -> DataFrame:
    """The proposals of words with their ink, boxes in both images, and vectors.

    Crops are cut from the image of the word's canvas (images.key), once for the words and once for their parts.
    """
    keyed = word_rows.withColumn("key", F.col("canvas_index").cast("string"))
    item = F.struct("folio", "source_index")
    crops = cut(imaging.crops(given.images, keyed.select("key", item.alias("item"), F.col("derivative_xywh").alias("box")), "key"))
    sized = crops.select("key", F.col("item.folio").alias("folio"), F.col("item.source_index").alias("source_index"), "width", "height", "components")
    parts = proposals.propose(sized, ["key", "folio", "source_index"], given.limits).where("box.w >= 4 AND box.h >= 4 AND box.w * box.h >= 24")
    context = keyed.select("folio", "source_index", "canvas_index", "eva", "line_index", "line_start", "site_class", F.col("derivative_xywh").alias("word_box"), F.col("yale_xywh").alias("word_full"))
    placed = parts.join(context, ["folio", "source_index"])
    small, full = proposals.in_page(F.col("box"), F.col("word_box"), F.col("word_full"))
    placed = cut(placed.withColumn("word_relative_xywh", F.col("box")).withColumn("yale_xywh", full).withColumn("derivative_xywh", small).withColumn("proposal_id", F.xxhash64("folio", "source_index", "proposal_index")))
    inked = imaging.crops(given.images, placed.select("key", F.col("proposal_id").alias("item"), F.col("derivative_xywh").alias("box")), "key").where(proposals.keeps_ink(F.col("ink")))
    vectors = imaging.embedded(inked.withColumnRenamed("item", "proposal_id"), ["proposal_id"], given.model)
    ink = inked.select(F.col("item").alias("proposal_id"), F.col("ink").alias("ink_fraction"))
    kept = ["proposal_id", "folio", "canvas_index", "source_index", "eva", "line_index", "line_start", "proposal_index", "proposal_type", "word_relative_xywh", "derivative_xywh", "yale_xywh", "site_class"]
    return placed.select(*kept).join(ink, "proposal_id").join(vectors, "proposal_id")


def word_vectors(given: Inputs, word_rows: DataFrame) -> DataFrame:
    """The words with word_id and the vectors of their crops: raw, ink (normalised), fused (the sum of both, of unit length)."""
    keyed = word_rows.withColumn("key", F.col("canvas_index").cast("string")).withColumn("word_id", F.xxhash64("folio", "source_index"))
    boxes = keyed.select("key", F.col("word_id").alias("item"), F.col("derivative_xywh").alias("box"))
    raw, ink = (imaging.embedded(imaging.crops(given.images, boxes, "key", normalise).withColumnRenamed("item", "word_id"), ["word_id"], given.model) for normalise in (False, True))
    both = raw.select("word_id", _unit("vec").alias("raw")).join(ink.select("word_id", _unit("vec").alias("ink")), "word_id")
    both = both.withColumn("fused", _unit(F.zip_with("raw", "ink", lambda a, b: a + b)))
    return keyed.select("word_id", "folio", "source_index", "eva", "site_class", "line_start").join(both, "word_id")


def _unit(vec: str | Column) -> Column:
    wide = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    return F.transform(wide, lambda x: x / (F.sqrt(dot(wide, wide)) + 1e-9))


def augmented_stability(given: Inputs, rows: DataFrame, found: DataFrame, least: int = 10, folios: int = 3, most: int = 80, each: int = 12) -> DataFrame:
    """One row (tested, own_rate, mean_cosine): how often altered pictures of members fall to their own cluster's centre.

    Of the first `most` clusters of at least `least` members on `folios` folios, the crops of the first `each` members
    are cut again, altered in four ways and embedded. Without such clusters the rates are null.
    """
    placed = rows.join(found.where("cluster_id >= 0").select(F.col("id").alias("proposal_id"), "cluster_id"), "proposal_id")
    eligible = placed.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("folio").alias("folios")).where((F.col("size") >= least) & (F.col("folios") >= folios))
    members = cut(placed.join(eligible.orderBy("cluster_id").limit(most).select("cluster_id"), "cluster_id"))
    if members.isEmpty():
        return rows.sparkSession.createDataFrame([(0, None, None)], "tested bigint, own_rate double, mean_cosine double")
    order = Window.partitionBy("cluster_id").orderBy("folio", "source_index", "proposal_index")
    picked = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    again = imaging.crops(given.images, picked.select(F.col("canvas_index").cast("string").alias("key"), F.col("proposal_id").alias("item"), F.col("derivative_xywh").alias("box")), "key")
    variants = imaging.embedded(imaging.varied(again.withColumnRenamed("item", "id")), ["id", "kind"], given.model)
    return audit.stability(members.select(F.col("proposal_id").alias("id"), "vec", "cluster_id"), variants, "id", "vec")


def dense_audit(given: Inputs, word_rows: DataFrame, below: int = 2, most: int = 700, least: int = 20, draws: int = 300) -> DataFrame:
    """One row (n_images, same_mean, different_mean, auc, same_n, different_n): how alike the patches of two words of one label on two folios are, and of two labels.

    The words are a hash sample, at most `most`; under `least` nothing is measured.
    """
    drawn = cut(byte_sample(word_rows, ["folio", "source_index"], below, "dense", most, ["folio", "source_index"]).withColumn("word_id", F.xxhash64("folio", "source_index")))
    n, kind = drawn.count(), "n_images bigint, same_mean double, different_mean double, auc double, same_n bigint, different_n bigint"
    if n < least or isinstance(given.model, Column):
        return word_rows.sparkSession.createDataFrame([(n, None, None, None, 0, 0)], kind)
    boxes = drawn.select(F.col("canvas_index").cast("string").alias("key"), F.col("word_id").alias("item"), F.col("derivative_xywh").alias("box"))
    tokens = imaging.embedded(imaging.crops(given.images, boxes, "key").withColumnRenamed("item", "id"), ["id"], given.model, dense=True)
    patches = cut(tokens.select("id", F.posexplode("patches").alias("patch", "vec")))
    lies = drawn.select(F.col("word_id").alias("w"), "folio")
    pairs = stats.sampled_pairs(drawn, "word_id", "eva", min(draws, 2 * n))
    pairs = pairs.join(lies.select(F.col("w").alias("a"), F.col("folio").alias("fa")), "a").join(lies.select(F.col("w").alias("b"), F.col("folio").alias("fb")), "b").where("NOT same OR fa <> fb")
    pairs = cut(pairs.select("draw", "a", "b", "same"))
    scored = cut(pairs.join(stats.max_similarity(patches, pairs.select("a", "b").distinct()), ["a", "b"]))
    means = scored.agg(F.avg(F.when(F.col("same"), F.col("score"))).alias("same_mean"), F.avg(F.when(~F.col("same"), F.col("score"))).alias("different_mean"), F.count_if("same").alias("same_n"), F.count_if(~F.col("same")).alias("different_n"))
    both = means.join(F.broadcast(stats.auc(scored, "score", "same").select("auc")), how="full")  # one row each
    return both.select(F.lit(n).cast("bigint").alias("n_images"), "same_mean", "different_mean", "auc", "same_n", "different_n")


def model_agreement(given: Inputs, rows: DataFrame, word_rows: DataFrame, most: int = 1600) -> DataFrame:
    """One row (status, n, mean_knn10_jaccard): how far two models agree on the ten nearest of a hash sample of proposals and words."""
    kind = "status string, n bigint, mean_knn10_jaccard double"
    spark = rows.sparkSession
    if given.large is None:
        return spark.createDataFrame([("not_run", None, None)], kind)
    box = [F.col("canvas_index").cast("string").alias("key"), F.col("derivative_xywh").alias("box")]
    parts = byte_sample(rows, ["folio", "source_index", "proposal_index"], 3).select(F.xxhash64(F.lit("proposal"), "folio", "source_index", "proposal_index").alias("item"), *box)
    whole = byte_sample(word_rows, ["folio", "source_index"], 2, "auditword").select(F.xxhash64(F.lit("word"), "folio", "source_index").alias("item"), *box)
    crops = cut(imaging.crops(given.images, parts.unionByName(whole).orderBy("item").limit(most), "key"))
    try:
        near = [exact_knn(imaging.embedded(crops, ["item"], m), "item", "vec", 10) for m in (given.model, given.large)]
        return cut(stats.neighbour_agreement(*near).agg(F.lit("ok").alias("status"), F.count("*").alias("n"), F.avg("jaccard").alias("mean_knn10_jaccard")))
    except Exception as e:  # the second model is an extra: without it the run goes on
        return spark.createDataFrame([(f"failed: {type(e).__name__}", crops.count(), None)], kind)


class Run:
    """The stages of a run, each made once when it is first asked for."""

    def __init__(self, given: Inputs) -> None:
        self.given = given

    @cached_property
    def chosen(self) -> DataFrame:
        return cut(registered(self.given))

    @cached_property
    def words(self) -> DataFrame:
        return cut(words(self.given, self.chosen))

    @cached_property
    def proposals(self) -> DataFrame:
        return cut(proposal_crops(self.given, self.words))

    @cached_property
    def word_vectors(self) -> DataFrame:
        return cut(word_vectors(self.given, self.words))

    @cached_property
    def discovered(self) -> tuple[DataFrame, DataFrame, float]:
        found, edges, threshold = audit.discovered(self.proposals, "proposal_id", "vec", folio="folio", most=self.given.most_discovered)
        return cut(found), edges, threshold

    @cached_property
    def clusters(self) -> DataFrame:
        """A summary of each cluster: sizes, folios, types, cosines, medoid."""
        return cut(audit.cluster_report(self.proposals, self.discovered[0], "proposal_id", "vec", F.col("folio"), F.col("proposal_type")))

    def held_out(self) -> DataFrame:
        """The held-out test by pairs of conjoint leaves: both leaves of a pair are on one side, leaves of no pair on none."""
        return audit.holdout_test(with_pair(self.proposals), "proposal_id", "vec", "folio", F.col("pair"))

    def picks(self, sheets: int = 24, least_folios: int = 3) -> DataFrame:
        """(cluster_id, pick, folio, source_index, proposal_index, proposal_type, yale_xywh, width, height, data): what the contact sheet shows.

        Of the first `sheets` clusters on at least three folios: the medoid, then the first member of each folio, six in all.
        """
        shown = self.clusters.where(F.col("distinct_folios") >= least_folios).orderBy("cluster_id").limit(sheets)
        members = self.proposals.join(self.discovered[0].select(F.col("id").alias("proposal_id"), "cluster_id"), "proposal_id").join(F.broadcast(shown.select("cluster_id")), "cluster_id")
        chosen = display_picks(members, shown.select("cluster_id", F.col("medoid").alias("proposal_id")), "cluster_id", "proposal_id", "folio")
        told = chosen.join(self.proposals.select("proposal_id", "canvas_index", "folio", "source_index", "proposal_index", "proposal_type", "derivative_xywh", "yale_xywh"), "proposal_id")
        boxes = told.select(F.col("canvas_index").cast("string").alias("key"), F.col("proposal_id").alias("item"), F.col("derivative_xywh").alias("box")).distinct()
        crops = imaging.crops(self.given.images, boxes, "key", normalise=False).select(F.col("item").alias("proposal_id"), "width", "height", "data")
        return told.join(crops, "proposal_id").select("cluster_id", "pick", "folio", "source_index", "proposal_index", "proposal_type", "yale_xywh", "width", "height", "data")

    def contact_sheet(self) -> tuple[bytes, DataFrame]:
        """The picture of the picks, and the clusters shown with their members."""
        picks = cut(self.picks())
        members = picks.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pick", "folio", "source_index", "proposal_index", "proposal_type", "yale_xywh"))).alias("members"))
        return sinks.contact_sheet(picks.withColumnRenamed("cluster_id", "cluster")), self.clusters.join(members, "cluster_id")

    def artefacts(self) -> DataFrame:
        """(name, chunk, chunks, part): the registrations and the clusters shown as deflated JSON, and the contact sheet, in base64."""
        sheet, medoids = self.contact_sheet()
        packed = None
        for name, rows, key in (("REGISTRATIONS_ZLIB_B64", self.chosen, "folio"), ("MEDOIDS_ZLIB_B64", medoids, "cluster_id")):
            one = sinks.base64_chunks(sinks.deflated_parts(rows, key, name).select(F.concat_ws("_", "name", "no").alias("name"), "data"), "name", "data")
            packed = one if packed is None else packed.unionByName(one)
        shown = self.chosen.sparkSession.createDataFrame([("CONTACT_SHEET_PNG_B64", bytearray(sheet))], "name string, data binary")
        return packed.unionByName(sinks.base64_chunks(shown, "name", "data"))


def with_pair(rows: DataFrame) -> DataFrame:
    """rows (folio, ...) with pair, the number of the pair of conjoint leaves that the folio's leaf belongs to, or null."""
    pairs = rows.sparkSession.createDataFrame(leaf_pairs(), "pair int, a int, b int").select("pair", F.explode(F.array("a", "b")).alias("__leaf"))
    return rows.withColumn("__leaf", leaf_base(F.col("folio"))["n"]).join(F.broadcast(pairs), "__leaf", "left").drop("__leaf")


def verdict(given: Inputs | Run, not_hand: bool = False, visual_audit: bool = False, shown: int = 200) -> DataFrame:
    """(value): the summary line of a whole run: counts, registrations, audits, clusters, measures and the gate."""
    run = given if isinstance(given, Run) else Run(given)
    given = run.given
    rows, seen, (found, edges, threshold) = run.proposals, run.word_vectors, run.discovered
    held = cut(run.held_out())
    tests = audit.variant_function_test(seen, "eva", "word_id", "ink", "folio", "line_start").agg(F.count_if("significant").alias("significant"), F.count("*").alias("tested_labels"), F.median("observed").alias("median_gap"))
    stable = augmented_stability(given, rows, found).select(F.col("own_rate").alias("stability"), F.col("tested").alias("variants_tested"))
    audits = [audit.word_audit(seen, "word_id", kind, "eva", "folio").select(F.struct("*").alias(f"words_{kind}")) for kind in ("raw", "ink", "fused")]
    audits += [one.select(F.struct("*").alias(name)) for name, one in (("leakage", audit.leakage(seen, "ink", "site_class", "folio")), ("held_out", held), ("dense", dense_audit(given, run.words)), ("second_model", model_agreement(given, rows, run.words)), ("registration", registration.report(run.chosen)))]
    public = run.clusters.orderBy("cluster_id").limit(shown).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "size", "distinct_folios", "top_folios", F.map_entries("proposal_types").alias("proposal_types"), "mean_centroid_cosine", "p05_centroid_cosine", "medoid"))).alias("cluster_summaries"))
    measures = stable.join(F.broadcast(tests), how="full").join(F.broadcast(held.select(F.col("fraction").alias("recurrence"))), how="full")  # one row each
    counted = audit.gate(measures, not_hand, visual_audit)
    counts = {"proposals": rows, "mutual_edges": edges, "clusters": run.clusters, "accepted_pages": run.chosen.where("accepted"), "pages": given.folios(), "words": run.words}
    for name, table in counts.items():
        counted = counted.withColumn(name, F.lit(table.count()))
    for one in [*audits, public]:
        counted = counted.join(F.broadcast(one), how="full")  # one row each
    return sinks.summary_line(counted.withColumn("threshold", F.lit(threshold)).withColumn("mode", F.lit(given.mode)))
