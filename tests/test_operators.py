import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.config import BASE_LIMITS, CURRENT_LIMITS, leaf_pairs
from quirework.operators import audit, graph, homography, imaging, knn, layout, proposals, registration, relational, sampling, stats
from quirework.plans.prefix import running_sum

BOXES = "folio string, source_index int, x double, y double, w double, h double"


def test_infer_lines_and_places(spark):
    rows = [("a", 0, 10.0, 0.0, 5.0, 10.0), ("a", 1, 0.0, 1.0, 5.0, 10.0), ("a", 2, 0.0, 30.0, 5.0, 10.0), ("a", 3, None, 1.0, 1.0, 1.0)]
    got = {r["source_index"]: (r["line_index"], r["token_index"], r["line_length"], r["line_start"], r["line_end"]) for r in layout.infer_lines(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == {1: (0, 0, 2, True, False), 0: (0, 1, 2, False, True), 2: (1, 0, 1, True, True)}
    assert layout.infer_lines(spark.createDataFrame([], BOXES)).collect() == []


def folded(boxes):
    rows = np.array(boxes, float).reshape(-1, 5)
    index, line = layout.fold_lines(rows[:, 0].astype(int), rows[:, 1], rows[:, 2], rows[:, 4])
    return sorted(zip(index.tolist(), line.tolist()))


def test_lines_follow_medians_not_gaps():
    assert folded([(i, 0.0, c - 5.0, 5.0, 10.0) for i, c in enumerate((0, 8, 16))]) == [(0, 0), (1, 0), (2, 1)]


def test_lines_equal_a_search_of_all_lines():
    rng = np.random.default_rng(8)
    for _ in range(60):
        boxes = [(i, float(rng.integers(0, 50)), float(rng.integers(0, 90)), 5.0, float(rng.integers(4, 30))) for i in range(rng.integers(1, 40))]
        limit, lines = max(8.0, 0.65 * float(np.median([b[4] for b in boxes]))), []
        for i, x, y, w, h in sorted(boxes, key=lambda b: (b[2] + b[4] / 2, b[1], b[0])):
            gaps = [abs(y + h / 2 - np.median([c for _, c in line])) for line in lines]
            if not gaps or min(gaps) > limit:
                lines.append([])
                gaps.append(-1.0)
            lines[int(np.argmin(gaps))].append((i, y + h / 2))
        lines.sort(key=lambda line: np.median([c for _, c in line]))
        assert folded(boxes) == sorted((i, n) for n, line in enumerate(lines) for i, _ in line)


def test_neighbours_are_survivors(spark):
    rows = spark.createDataFrame([("a", 0), ("c", 2)], "eva string, token_index int").withColumn("l", F.lit(0))
    got = {r["eva"]: (r["prev_eva"], r["next_eva"]) for r in layout.neighbours_in_line(rows, ["l"], ["token_index"]).collect()}
    assert got == {"a": (None, "c"), "c": ("a", None)}


def test_word_records(spark):
    boxes = spark.createDataFrame([("f1r", 0, 0, 0.0, 0.0, 20.0, 10.0), ("f1r", 1, 9, 30.0, 0.0, 20.0, 10.0), ("f9r", 0, 0, 0.0, 0.0, 20.0, 10.0)], "folio string, source_index int, word_index int, x double, y double, w double, h double")
    labels = spark.createDataFrame([("f1r", 0, "dol")], "folio string, word_index int, eva string")
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    chosen = spark.createDataFrame([("f1r", 3, "1r", unit, [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 1.0]], 100, 50, 200, 100, True)], "folio string, candidate_index int, candidate_label string, homography_derivative array<array<double>>, homography_full array<array<double>>, target_width int, target_height int, canvas_width int, canvas_height int, accepted boolean")
    inventory = spark.createDataFrame([("f1r", "old", 1), ("f1r", "new", 2)], "folio string, site_class string, ord int")
    got = {r["source_index"]: r for r in layout.word_records(boxes, labels, chosen, inventory).collect()}
    assert set(got) == {0, 1} and got[0]["eva"] == "dol" and got[1]["eva"] is None and got[0]["site_class"] == "new"
    assert tuple(got[1]["derivative_xywh"]) == (25, 0, 30, 15) and tuple(got[1]["yale_xywh"]) == (50, 0, 60, 30)
    assert got[0]["next_eva"] is None and got[1]["prev_eva"] == "dol" and got[0]["line_length"] == 2


def test_windows_and_merging(spark):
    def of(limits):
        boxes = spark.range(1).select(proposals.window_boxes(F.lit(100), F.lit(20), limits).alias("b")).first()["b"]
        return [(b["w"], b["x"]) for b in boxes]

    assert of(CURRENT_LIMITS) == [(38, 0), (38, 23), (38, 46), (38, 62), (62, 0), (62, 37), (62, 38)]
    assert of(BASE_LIMITS) == [(38, 0), (38, 19), (38, 38), (38, 57), (38, 62), (62, 0), (62, 31), (62, 38)]
    parts = spark.createDataFrame([([(0, 0, 10, 20), (12, 2, 8, 18), (40, 0, 10, 20)],), ([],), (None,)], f"p array<{proposals.BOX}>")
    got = [[tuple(b) for b in r["m"]] for r in parts.select(proposals.merged_boxes(F.col("p")).alias("m")).collect()]
    assert got == [[(0, 0, 20, 20)], [], []]


def test_propose(spark):
    kind = "array<struct<x:int,y:int,w:int,h:int,ink:int>>"
    words = spark.createDataFrame([(1, 100, 20, [(0, 0, 10, 20, 90), (12, 2, 8, 18, 80), (40, 0, 10, 20, 70), (60, 0, 2, 2, 4)]), (2, 5, 5, []), (3, 20, 20, None)], f"k int, width int, height int, components {kind}")
    rows = proposals.propose(words, ["k"]).where("k = 1").orderBy("proposal_index").collect()
    assert [r["proposal_type"] for r in rows][:4] == ["component"] * 3 + ["merged_component"] and len(rows) == 11
    assert [r["proposal_index"] for r in rows] == list(range(11))
    assert {r["k"] for r in proposals.propose(words, ["k"]).collect()} == {1, 3}


def attempts(spark, rows):
    return spark.createDataFrame(rows, "folio string, candidate_index int, accepted boolean, inliers int, inlier_ratio double, median_reprojection_px double, error string")


def test_selected(spark):
    nan = float("nan")
    got = registration.selected(attempts(spark, [("a", 1, True, 60, 0.6, 2.0, None), ("a", 2, True, 60, 0.6, 1.0, None), ("a", 3, False, 900, 0.9, 0.1, None), ("b", 1, False, 5, nan, nan, None), ("b", 2, False, 5, 0.1, 9.0, None), ("c", 1, None, None, None, None, "x"), (None, 1, True, 1, 1.0, 1.0, None), ("d", 4, True, 9, 0.5, 1.0, None), ("d", 3, True, 9, 0.5, 1.0, None)]))
    assert {r["folio"]: r["candidate_index"] for r in got.collect()} == {"a": 2, "b": 2, "d": 3}
    assert registration.selected(attempts(spark, [])).collect() == []


def test_candidates_and_second_wave(spark):
    folios = spark.createDataFrame([("f1r",), ("f5v",), ("fRos",), (None,)], "folio string")
    canvases = spark.createDataFrame([(0, "1r"), (1, "Folio 4r-4v"), (2, "15v"), (3, None), (4, "1r")], "index int, label string")
    assert {tuple(r) for r in registration.candidates(folios, canvases).collect()} == {("f1r", 0), ("f1r", 4), ("f5v", 1)}
    tried = []

    def attempt(pairs):
        tried.append({tuple(r) for r in pairs.collect()})
        return attempts(spark, [(f, i, i == 4 and len(tried) == 2, 1, 0.1, 1.0, None) for f, i in tried[-1]])

    near = spark.createDataFrame([(0, "1r"), (4, "2v")], "index int, label string")
    every, chosen = registration.register(folios, near, attempt)
    assert tried == [{("f1r", 0)}, {("f1r", 4)}] and {(r["folio"], r["candidate_index"]) for r in chosen.collect()} == {("f1r", 4)}


def test_scales(spark):
    def of(w):
        return spark.range(1).select(registration.scales(F.lit(w)).alias("s")).first()["s"]

    assert of(1500) == [1000, 1200, 1400, 1500] and of(700) == [700] and of(500) == [] and of(1800) == [1000, 1200, 1400, 1600, 1800]


def test_adjudication(spark):
    base = attempts(spark, [("a", 1, False, 30, 0.5, 2.0, None), ("b", 1, True, 60, 0.6, 1.0, None), ("c", 1, False, 30, 0.5, 2.0, None)]).withColumn("candidate_label", F.lit("x"))
    rules = spark.createDataFrame([("a", 1, "x", 20, 0.4, 3.0, True), ("c", 2, "x", 20, 0.4, 3.0, True)], "folio string, candidate_index int, candidate_label string, min_inliers int, min_ratio double, max_median_px double, evidence boolean")
    assert {r["folio"]: (r["accepted"], r["acceptance_basis"]) for r in registration.adjudicated(base, rules).collect()} == {"a": (True, "adjudicated"), "b": (True, "automatic"), "c": (False, None)}


def test_auc_and_bh(spark):
    rows = spark.createDataFrame([(0.9, True), (0.4, True), (0.5, False), (0.4, False), (float("nan"), True)], "s double, p boolean")
    assert stats.auc(rows, "s", "p").first()["auc"] == 0.625
    assert stats.auc(rows.where("p"), "s", "p").first()["auc"] is None
    for ps, n in (((0.01, 0.02, 0.04, 0.2), 2), ((0.03, 0.035, 0.036, 0.037), 4), ((0.9, None), 0)):
        found = stats.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double"), "p")
        assert found.where("significant").count() == n


def test_retrieval_keeps_the_ranks_of_own_group(spark):
    near = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "i long, j long, rank int")
    labels = spark.createDataFrame([(1, "a", "f"), (2, "a", "f"), (3, "a", "g"), (4, None, "f")], "id long, label string, grp string")
    row = stats.retrieval(near, labels).first()
    assert (row["queries"], row["hit_at_1"], row["mrr"]) == (3, 0.0, pytest.approx(0.5 / 3))


def test_permutation_p(spark):
    rows = spark.createDataFrame([("w", f"f{i % 2}", i < 20, i < 20, i) for i in range(40)], "g string, s string, side boolean, flag boolean, k int")
    row = stats.permutation_test(rows, "g", "side", "flag", ["s"]).first()
    assert (row["n"], row["observed"], row["p"]) == (40, 1.0, pytest.approx(1 / 201))


def test_permutation_draws_follow_shuffles(spark):
    rng = np.random.default_rng(5)
    side, flag, stratum = rng.random(120) < 0.4, rng.random(120) < 0.3, rng.integers(0, 3, 120)
    rows = spark.createDataFrame([("w", f"f{s}" if s else None, bool(a), bool(b)) for s, a, b in zip(stratum, side, flag)], "g string, s string, side boolean, flag boolean")
    row = stats.permutation_test(rows, "g", "side", "flag", ["s"], 2000).first()
    seen, null = abs(flag[side].mean() - flag[~side].mean()), []
    for _ in range(4000):
        mixed = side.copy()
        for s in range(3):
            mixed[stratum == s] = rng.permutation(mixed[stratum == s])
        null.append(abs(flag[mixed].mean() - flag[~mixed].mean()))
    assert row["observed"] == pytest.approx(seen) and row["p"] == pytest.approx(np.mean(np.array(null) >= seen - 1e-12), abs=0.05)
    assert stats.permutation_test(rows.repartition(7), "g", "side", "flag", ["s"], 2000).first()["p"] == row["p"]
    assert stats.permutation_test(rows.where("side"), "g", "side", "flag", ["s"]).first()["observed"] is None
    assert stats.permutation_test(rows.limit(0), "g", "side", "flag", ["s"]).collect() == []


def test_gates_refuse_nan(spark):
    nan = float("nan")
    kind = "plausible_intersection boolean, inliers int, inlier_ratio double, median_reprojection_px double, intersection_ratio double, target_area_ratio double, homography_derivative array<array<double>>"
    unit = [[1.0, 0.0], [0.0, 1.0]]
    rows = spark.createDataFrame([(True, 60, 0.6, 1.0, 0.9, 0.5, unit), (True, 60, nan, 1.0, nan, 0.5, unit), (True, 60, 0.6, nan, 0.9, nan, unit), (True, None, 0.6, 1.0, 0.9, 0.5, [[nan]])], kind)
    got = rows.select(registration.accepted().alias("a"), registration.plausible().alias("p")).collect()
    assert [r["a"] for r in got] == [True, False, False, False] and [r["p"] for r in got] == [True, False, False, False]


def test_two_sides_and_folds(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(30, 4)) + 3, rng.normal(size=(20, 4)) - 3]
    rows = spark.createDataFrame([("w", i, v.tolist()) for i, v in enumerate(x)] + [("one", 99, [1.0] * 4), ("w", 100, None)], "l string, k int, v array<double>")
    got = {r["k"]: r["side"] for r in audit.two_sides(rows, "l", "k", "v").where("l = 'w'").collect()}
    assert len({got[i] for i in range(30)}) == len({got[i] for i in range(30, 50)}) == 1 and got[0] != got[40]
    folds = audit.balanced_folds([(str(i), n) for i, n in enumerate((9, 1, 1, 4, 5, 3, 1))], 3)
    sums = [sum(n for g, n in ((str(i), n) for i, n in enumerate((9, 1, 1, 4, 5, 3, 1))) if (g, f) in folds) for f in range(3)]
    assert sorted(sums) == [7, 8, 9] and len(audit.balanced_folds([("a", 1)], 5)) == 1


def test_holdout_of_few_has_the_same_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "f1r", 0)], "id int, v array<double>, folio string, pair int")
    got = audit.holdout_test(rows, "id", "v", "folio", F.col("pair"))
    assert got.first()["status"] == "insufficient" and "fraction" in got.columns


def test_index_beyond_a_size(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 10, 0) + rng.normal(size=(400, 8)) * 0.2
    rows = spark.createDataFrame([(i, v.tolist(), f"f{i % 7}") for i, v in enumerate(x)], "vec_id long, embedding array<double>, folio string")
    exact = {(r["i"], r["j"]) for r in knn.nearest_rows(rows, k=5).collect()}
    found = {(r["i"], r["j"]) for r in knn.nearest_rows(rows, k=5, exact_upto=100).collect()}
    assert len(exact) == 2000 and len(exact & found) >= 0.9 * len(exact)
    labels, _, _ = audit.discovered(rows, "vec_id", "embedding", 5, 0.5, 0.5, (2, 50), "folio", 150)
    assert 0 < labels.count() <= 150
    assert knn.nearest_rows(rows.limit(0)).collect() == []


def test_reprojection(spark):
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = spark.createDataFrame([("a", 1.0, 1.0, 4.0, 5.0, True, unit), ("a", 2.0, 2.0, 2.0, 3.0, True, unit), ("a", 0.0, 0.0, 90.0, 0.0, False, unit)], "folio string, x1 double, y1 double, x2 double, y2 double, inlier boolean, homography_derivative array<array<double>>")
    row = registration.reprojection(rows, ["folio"]).first()
    assert (row["matches"], row["inliers"], row["median_reprojection_px"]) == (3, 2, 3.0) and row["p95_reprojection_px"] == pytest.approx(4.8)


def test_from_descriptors_to_a_registration(spark):
    rng = np.random.default_rng(6)
    h = np.array([[1.5, 0.1, 20.0], [-0.05, 1.4, 10.0], [1e-5, 2e-5, 1.0]])
    p = rng.uniform(0, 300, size=(150, 2))
    moved = np.c_[p, np.ones(150)] @ h.T
    q = moved[:, :2] / moved[:, 2:]
    vec = rng.normal(size=(150, 16))
    kind = "x double, y double, vec array<double>"
    sources = spark.createDataFrame([("f1r", *map(float, a), v.tolist()) for a, v in zip(p, vec)] + [("f2r", 1.0, 1.0, [1.0] * 16)], "folio string, " + kind)
    wrong = rng.uniform(0, 400, size=(50, 2))
    at = np.r_[wrong, q[50:]]  # the first fifty are found in the wrong place
    targets = spark.createDataFrame([(3, *map(float, b), (v + 0.001).tolist()) for b, v in zip(at, vec)] + [(4, 0.0, 0.0, None)], "index int, " + kind)
    pairs = spark.createDataFrame([("f1r", 3), ("f1r", 3), ("f2r", 3), ("f1r", 4), (None, 3)], "folio string, index int")
    matches = homography.descriptor_matches(pairs, sources, targets, 0.9)
    found = homography.homographies(matches, pairs.where("folio IS NOT NULL"))
    folios = spark.createDataFrame([("f1r", 300, 300), ("f2r", 300, 300)], "folio string, source_width int, source_height int")
    canvases = spark.createDataFrame([(i, "1r", "c", "b", 1200, 1200, 600, 600) for i in (3, 4)], "index int, label string, canvas_id string, body_id string, width int, height int, target_width int, target_height int")
    got = {(r["folio"], r["candidate_index"]): r for r in homography.registrations(found, folios, canvases).collect()}
    good = got["f1r", 3]
    assert good["accepted"] and good["matches"] == 150 and 100 <= good["inliers"] <= 103 and good["median_reprojection_px"] < 1e-6
    assert np.allclose(good["homography_derivative"], h, atol=1e-4) and np.allclose(good["homography_full"][0], 2 * h[0], atol=1e-3) and 0.9 < good["intersection_ratio"] <= 1
    assert got["f1r", 4]["error"] and got["f2r", 3]["error"] and not got["f2r", 3]["accepted"] and len(got) == 3
    assert homography.robust(p[:3], q[:3]) is None and homography.robust(np.zeros((9, 2)), np.zeros((9, 2))) is None


def test_agreement_and_maxsim(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "i long, j long")
    b = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "i long, j long")
    assert stats.neighbour_agreement(a, b).first()["jaccard"] == 0.5
    patches = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (2, 0, [3.0, 0.0])], "id long, patch int, vec array<double>")
    assert stats.max_similarity(patches, spark.createDataFrame([(1, 2)], "a long, b long")).first()["score"] == pytest.approx(0.5)


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_and_pairs(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    x[5] = x[6]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(3, x[3].tolist(), 0), (None, x[0].tolist(), 1), (99, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in knn.exact_knn(df, k=4, block=block).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for i in range(40):
        assert got[i] == sorted((j for j in range(40) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:4]
    found = stats.auc_of_histogram(knn.pair_histogram(df.where("vec_id < 40"), "vec_id", "embedding", "label", block=block)).first()
    pos = [round(s[i, j], 6) for i in range(40) for j in range(i) if i % 3 == j % 3]
    neg = [round(s[i, j], 6) for i in range(40) for j in range(i) if i % 3 != j % 3]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert found["auc"] == pytest.approx(want, abs=1e-4) and found["positives"] == len(pos)
    assert knn.exact_knn(df.limit(0)).collect() == []


def test_components_any_order(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    want = {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
    for n in (1, 4):
        random.shuffle(edges)
        got = graph.components(spark.createDataFrame(edges, "i long, j long").repartition(n))
        assert {tuple(r) for r in got.collect()} - {(7, 7)} == want - {(7, 7)}


def test_cluster_bounds(spark):
    labels = spark.createDataFrame([(c * 10000 + i, c) for c, n in ((0, 4), (1, 5), (2, 2000), (3, 2001)) for i in range(n)], "id long, component long")
    got = {r["component"]: r["cluster_id"] for r in graph.numbered_clusters(labels, 5, 2000).select("component", "cluster_id").distinct().collect()}
    assert got == {0: -1, 1: 1, 2: 0, 3: -1}


def test_gate(spark):
    m = spark.createDataFrame([(0.9, 0.6, 3), (None, None, None)], "stability double, recurrence double, significant int")
    assert [r["admitted"] for r in audit.gate(m).collect()] == [False, False]
    assert [r["admitted"] for r in audit.gate(m, True, True).collect()] == [True, False]


def test_held_out_pairs(spark):
    pairs = spark.createDataFrame(leaf_pairs(), "pair int, a int, b int")
    assert len(leaf_pairs()) == 36
    assert [r["pair"] for r in pairs.where(audit.held_out(F.col("pair"))).orderBy("pair").collect()] == [8, 10, 14, 16, 20, 22, 23, 27, 29, 30, 31]


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(200)], "k long, s string")
    drawn = {r["k"] for r in sampling.byte_sample(rows, ["k"], 40).collect()}
    assert drawn == {r["k"] for r in sampling.byte_sample(rows.repartition(7), ["k"], 40).collect()} and 10 < len(drawn) < 60
    assert sampling.stratified_cap(rows, "s", "k", 30).count() == 30
    picks = sampling.display_picks(spark.createDataFrame([(1, i, f"f{i % 8}") for i in range(20)], "c int, k int, folio string"), spark.createDataFrame([(1, 9)], "c int, k int"), "c", "k", "folio")
    assert [r["k"] for r in picks.orderBy("pick").collect()] == [9, 0, 1, 2, 3, 4]


def test_relational(spark):
    left = spark.createDataFrame([(1,), (5,)], "a int")
    assert relational.band_join(left, spark.createDataFrame([(2,), (7,)], "b int"), "a", "b", 1).collect()[0]["b"] == 2
    assert [r["n"] for r in relational.zero_filled(spark.createDataFrame([(1, 4)], "k long, n long"), 3, "k", "n").orderBy("k").collect()] == [0, 4, 0]


def test_running_sum_equals_one_window(spark):
    random.seed(2)
    rows = [(random.choice("ab"), random.randint(0, 5), i, random.choice([None, 1, 2, 7])) for i in range(300)]
    df = running_sum(spark.createDataFrame(rows, "g string, b int, k int, v long"), "v", "s", "b", ["k"], ["g"])
    totals = {}
    for g, b, k, v in sorted(rows):
        totals[g] = totals.get(g, 0) + (v or 0)
        rows[rows.index((g, b, k, v))] = (g, b, k, v)
        totals[(g, b, k)] = totals[g]
    assert all(r["s"] == totals[(r["g"], r["b"], r["k"])] for r in df.collect())


def test_pixels():
    grey = np.full((30, 60), 255, np.uint8)
    grey[5:15, 5:15] = grey[8:28, 30:40] = 0
    assert [c[:4] for c in imaging.mask_components(imaging.ink_mask(grey))] == [(5, 5, 10, 10), (30, 8, 10, 20)]
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert imaging.mask_components(ring) == [(0, 0, 5, 5, 16)]
    assert imaging.mask_components(np.eye(4, dtype=bool)) == [(0, 0, 4, 4, 4)]
    assert imaging.ink_fraction(np.zeros((0, 3), np.uint8)) == 0.0 and 0 <= imaging.ink_fraction(grey) < 0.35
    assert imaging.padded(np.zeros((4, 40), np.uint8)).shape == (16, 40)
    assert imaging.normalised_ink(grey).shape == grey.shape and imaging.normalised_ink(grey[:2]).shape == (2, 60)
    assert (imaging.variant(grey, 2) <= imaging.variant(grey, 3)).all() and (imaging.variant(grey, 9) == grey).all()
    assert imaging.variant(grey, 4)[3, 10] == grey[4, 11] and imaging.equalised(np.full((16, 16), 7, np.uint8)).shape == (16, 16)


def test_report_over_none_accepted(spark):
    rows = attempts(spark, [("a", 1, False, 1, 0.1, 1.0, None)]).withColumn("p95_reprojection_px", F.lit(1.0))
    row = registration.report(rows).first()
    assert (row["accepted"], row["median_px"]) == (0, None)
