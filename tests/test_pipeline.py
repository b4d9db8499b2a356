"""A run from page images to the verdict, on a page drawn here."""

import base64
import json
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework import __main__ as main
from quirework.config import leaf_pairs
from quirework.operators import audit, imaging, stats
from quirework.plans import pipeline
from quirework.sources import readers, sinks

REGISTRATION = "folio string, candidate_index int, candidate_label string, target_width int, target_height int, canvas_width int, canvas_height int, inliers int, inlier_ratio double, median_reprojection_px double, p95_reprojection_px double, homography_derivative array<array<double>>, homography_full array<array<double>>, accepted boolean, error string"


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("targets")
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(400, 200, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    graphics = image.createGraphics()
    graphics.setColor(jvm.java.awt.Color.WHITE)
    graphics.fillRect(0, 0, 400, 200)
    graphics.setColor(jvm.java.awt.Color.BLACK)
    for n in range(12):
        graphics.fillRect(20 + 90 * (n % 4), 20 + 60 * (n // 4), 12, 30)
        graphics.fillRect(40 + 90 * (n % 4), 30 + 60 * (n // 4), 20, 12)
    graphics.dispose()
    jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(f"{folder}/0.png"))
    inventory = spark.createDataFrame([("f1r", "sec", 0), ("f9v", "sec", 1)], "folio string, site_class string, ord int")
    canvases = spark.createDataFrame([(0, "1r")], "index int, label string")
    boxes = spark.createDataFrame([("f1r", n, n % 3, 15.0 + 90 * (n % 4), 15.0 + 60 * (n // 4), 55.0, 40.0) for n in range(12)], "folio string, source_index int, word_index int, x double, y double, w double, h double")
    labels = spark.createDataFrame([("f1r", n, "abc"[n]) for n in range(3)], "folio string, word_index int, eva string")
    unit, twice = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 1.0]]

    def attempt(pairs):
        return spark.createDataFrame([(r["folio"], r["index"], "1r", 400, 200, 800, 400, 90, 0.9, 1.0, 2.0, unit, twice, True, None) for r in pairs.collect()], REGISTRATION)

    return pipeline.Inputs(inventory, canvases, labels, boxes, readers.images(spark, str(folder)), attempt)


def test_report(given):
    line = pipeline.registration_report(given).first()["value"]
    assert json.loads(line.removeprefix("REGISTRATION_REPORT="))["accepted"] == 1


def test_words_to_verdict(given):
    chosen = pipeline.registered(given)
    words = pipeline.words(given, chosen)
    assert words.count() == 12 and words.select("line_index").distinct().count() == 3
    rows = pipeline.proposal_crops(given, words)
    kinds = {r["proposal_type"] for r in rows.select("proposal_type").distinct().collect()}
    assert kinds <= {"component", "merged_component", "window"} and "window" in kinds
    assert rows.where("size(vec) <> 64 OR ink_fraction < 0.005").count() == 0
    end = json.loads(pipeline.verdict(given).first()["value"].removeprefix("FINAL_SUMMARY_JSON="))
    assert end["admitted"] is False and end["accepted_pages"] == 1 and end["proposals"] == rows.count()


def test_words_are_embedded_and_audited(given):
    seen = pipeline.word_vectors(given, pipeline.words(given, pipeline.registered(given)))
    assert seen.count() == 12 and seen.where("size(raw) = 64 AND size(ink) = 64 AND size(fused) = 64").count() == 12
    assert seen.where("raw <> ink").count() > 0
    end = json.loads(pipeline.verdict(given).first()["value"].removeprefix("FINAL_SUMMARY_JSON="))
    assert end["words"] == 12 and all(end[f"words_{kind}"]["n"] == 12 for kind in ("raw", "ink", "fused")) and end["leakage"]["status"] == "insufficient"


def test_stability_is_of_altered_pictures(given, spark):
    chosen = pipeline.registered(given)
    rows = pipeline.proposal_crops(given, pipeline.words(given, chosen)).where("proposal_type = 'window'")
    few = rows.orderBy("proposal_id").limit(20).withColumn("n", F.row_number().over(Window.orderBy("proposal_id"))).withColumn("folio", F.concat(F.lit("f"), F.col("n") % 3)).cache()
    found = few.select(F.col("proposal_id").alias("id"), F.lit(0).alias("cluster_id"))
    n = few.count()
    assert n >= 10
    got = pipeline.augmented_stability(given, few, found).first()
    assert got["tested"] == 4 * min(n, 12) and got["own_rate"] == 1.0 and got["mean_cosine"] < 1
    assert pipeline.augmented_stability(given, few.withColumn("folio", F.lit("f1r")), found).first()["tested"] == 0
    assert pipeline.augmented_stability(given, few.limit(9), found).first()["own_rate"] is None


def test_the_rest_of_the_summary(given):
    run = pipeline.Run(given)
    end = json.loads(pipeline.verdict(run).first()["value"].removeprefix("FINAL_SUMMARY_JSON="))
    assert end["held_out"]["status"] == "insufficient" and end["second_model"]["status"] == "not_run" and end["registration"]["accepted"] == 1
    assert end["mode"] == "full" and end["pages"] == 2 and isinstance(end["cluster_summaries"], list) and end["dense"]["n_images"] < 20
    parts = {(r["name"].rsplit("_B64", 1)[0], r["chunk"]): r["part"] for r in run.artefacts().collect()}
    told = json.loads(zlib.decompress(base64.b64decode(parts["REGISTRATIONS_ZLIB", 0])))
    assert [r["folio"] for r in told] == ["f1r"] and told[0]["homography_full"][0][0] == 2.0 and ("CONTACT_SHEET_PNG", 0) in parts


def test_smoke_mode_takes_the_named_pages(given):
    assert {r["folio"] for r in replace(given, mode="smoke").folios().collect()} == {"f1r"}
    assert {r["folio"] for r in given.folios().collect()} == {"f1r", "f9v"}
    assert main.parameters(["x", "--mode", "smoke"]).mode == "smoke" and main.parameters(["x"]).batch_size == 64


def test_dense_audit_and_two_models(given, spark):
    words = pipeline.words(given, pipeline.registered(given))
    many = words.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("source_index", F.col("source_index") + 100 * F.col("n")).withColumn("folio", F.concat(F.lit("f"), F.col("n"), F.lit("r")))
    row = pipeline.dense_audit(given, many, below=256).first()
    assert row["n_images"] == 48 and row["same_n"] > 50 and row["different_n"] > 50 and -1 <= row["different_mean"] <= row["same_mean"] + 0.2 and 0 <= row["auc"] <= 1
    rows = pipeline.proposal_crops(given, words)
    two = replace(given, large=imaging.small_pictures(256))
    found = pipeline.model_agreement(two, rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("source_index", F.col("source_index") + 50 * F.col("k")), words).first()
    assert found["status"] == "ok" and found["n"] >= 0 and (found["n"] < 2 or 0 <= found["mean_knn10_jaccard"] <= 1)

    def broken():
        raise OSError("no weights")

    assert pipeline.model_agreement(replace(given, large=imaging.Embedder(broken)), rows.withColumn("proposal_index", F.explode(F.sequence(F.lit(0), F.lit(300)))), words).first()["status"].startswith("failed")


def test_leaves_of_a_pair_share_a_side(spark):
    rows = spark.createDataFrame([(f"f{n}{s}",) for n in range(1, 110) for s in "rv"] + [("fRos",), (None,)], "folio string")
    placed = pipeline.with_pair(rows).withColumn("held", audit.held_out(F.col("pair"))).collect()
    by = {r["folio"]: (r["pair"], r["held"]) for r in placed}
    assert len(placed) == 220 and by["f12r"] == by["f60r"] == by["fRos"] == (None, None)
    for pair, a, b in leaf_pairs():
        assert by[f"f{a}r"] == by[f"f{b}v"] == (pair, pair in (8, 10, 14, 16, 20, 22, 23, 27, 29, 30, 31))


def test_contact_sheet(spark):
    picks = spark.createDataFrame([(0, 0, 4, 2, b"\0" * 8), (1, 0, 0, 0, b"")], "cluster int, pick int, width int, height int, data binary")
    assert sinks.contact_sheet(picks).startswith(b"\x89PNG") and sinks.contact_sheet(picks.limit(0)).startswith(b"\x89PNG")


def test_sampled_pairs(spark):
    rows = spark.createDataFrame([(i, f"l{i % 4}" if i < 90 else f"only{i}") for i in range(100)], "k long, l string")
    pairs = stats.sampled_pairs(rows, "k", "l", 300).collect()
    assert all(p["a"] % 4 == p["b"] % 4 and p["a"] < 90 for p in pairs if p["same"]) and sum(p["same"] for p in pairs) > 200
    assert {tuple(p) for p in pairs} == {tuple(p) for p in stats.sampled_pairs(rows.repartition(3), "k", "l", 300).collect()}
    assert stats.sampled_pairs(rows.limit(0), "k", "l", 5).collect() == []
