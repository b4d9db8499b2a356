"""Samples, best candidates, linked groups, splits and mixes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import components, mixing, sampling, splits, topn

KEYED = "key long, stratum string"


def keyed(spark, n, strata=3):
    return spark.createDataFrame([(i, f"s{i % strata}") for i in range(n)], KEYED)


def keys(df):
    return {r["key"] for r in df.collect()}


def test_sample_is_stable_and_grows(spark):
    small, large = keyed(spark, 300), keyed(spark, 900)
    a = keys(sampling.hash_sample(small, 0.2))
    assert a == keys(sampling.hash_sample(small.repartition(7), 0.2)) and 30 < len(a) < 90
    assert a == {k for k in keys(sampling.hash_sample(large, 0.2)) if k < 300}
    rates = spark.createDataFrame([("s0", 0.9), ("s1", float("nan")), ("s2", 7.0), ("s9", None)], "stratum string, rate double")
    b = keys(sampling.hash_sample(small, 0.2, rates))
    assert {k for k in b if k % 3 == 1} == set() and {k for k in b if k % 3 == 2} == {k for k in range(300) if k % 3 == 2}
    more = sampling.raised(rates.where("stratum = 's0'"), spark.createDataFrame([("s0", 0.1), ("s2", 0.5)], "stratum string, rate double"))
    assert {r["stratum"]: r["rate"] for r in more.collect()} == {"s0": 0.9, "s2": 0.5}
    assert keys(sampling.hash_sample(small.limit(0), 0.5)) == set()
    assert keys(sampling.hash_sample(spark.createDataFrame([(None, "s0")], KEYED), 1.0)) == set()


def test_kept_rates_only_rise(spark, tmp_path):
    folder, rows = str(tmp_path / "rates"), keyed(spark, 600)

    def run(default, *rates):
        given = spark.createDataFrame(list(rates), "stratum string, rate double") if rates else None
        return keys(sampling.hash_sample(rows, default, sampling.kept_rates(spark, folder, default, given)))

    first = run(0.2, ("s0", 0.5))
    second = run(0.1)  # lower rates take nothing back
    assert second == first
    third = run(0.3, ("s1", 0.05), ("s2", float("nan")))
    assert third > first and {k for k in third if k % 3 == 1} >= keys(sampling.hash_sample(rows.where("stratum = 's1'"), 0.2))


def test_first_delivery_does_not_move(spark):
    rows = [(1, " F01R", 1), (1, "f2r", 2), (2, None, 1), (2, "f2r", 3), (None, "f1r", 1), (3, "f3v", None), (3, "f4v", 9)]
    df = spark.createDataFrame(rows, "k long, folio string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {r["key"]: r["stratum"] for r in sampling.first_delivery(df, "k", F.lower("folio"), "at").collect()}
    assert got == {1: " f01r", 2: "", 3: "f4v"}
    early = {r["key"]: r["stratum"] for r in sampling.first_delivery(df.where("t = 1"), "k", F.lower("folio"), "at").collect()}
    assert all(got[k] == s for k, s in early.items())


REG = "folio string, candidate_index int, matches int, inliers int, inlier_ratio double, median_reprojection_px double, error string, rank string"
NAN, INF = float("nan"), float("inf")


def test_best_candidates(spark):
    good = [("f1r", i, 100, i, 0.5, 1.0, None, "x") for i in range(6)]
    bad = [("f1r", 9, 100, 101, 0.5, 1.0, None, ""), ("f1r", 10, 100, 99, NAN, 1.0, None, ""), ("f1r", 11, 100, 99, 0.5, INF, None, ""), ("f1r", 12, 100, 99, 0.5, NAN, None, ""), ("f1r", 13, 100, 99, 0.5, -1.0, None, ""), ("f1r", 14, 100, 99, 1.1, 1.0, None, ""), ("f1r", 15, 100, 99, 0.5, 1.0, "e", ""), ("f1r", 16, None, 99, 0.5, 1.0, None, ""), (None, 1, 9, 9, 0.5, 1.0, None, ""), ("cover", 1, 9, 9, 0.5, 1.0, None, ""), ("f1r", None, 100, 99, 0.5, 1.0, None, "")]
    again = [(" F001R ", 0, 100, 50, 0.5, 1.0, None, "x"), ("f1r", 3, 100, 5, 0.5, 1.0, None, "x"), ("f1r", 3, 100, 5, 0.5, 1.0, None, "x")]
    got = topn.best_candidates(spark.createDataFrame(good + bad + again, REG)).orderBy("rank").collect()
    assert [(r["folio"], r["candidate_index"], r["rank"]) for r in got] == [("f1r", 0, 1), ("f1r", 3, 2), ("f1r", 5, 3)]
    assert topn.best_candidates(spark.createDataFrame([], REG)).collect() == []


def test_group_limit_is_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 2)], "g int, s int")
    plan = topn.top_n(rows, ["g"], [F.desc("s")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def brute(edges, loops=False):
    parent = {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or (a == b and not loops):
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {(x, top(x)) for x in parent}


@pytest.mark.parametrize("loops, find", [(False, components.hook_components), (True, splits.frontier_components)])
def test_components(spark, loops, find):
    random.seed(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + random.randint(0, 60), 100 + random.randint(0, 60)) for _ in range(40)] + [(300, 300 + i) for i in range(1, 30)] + [(5, 4), (5, 4), (77, 77), (None, 3), (4, None), (None, None), (-5, -9)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("id", F.lit("x")).withColumn("group_id", F.lit(1))
    assert {tuple(r) for r in find(df, "a", "b").collect()} == brute(edges, loops)
    assert {tuple(r) for r in find(df.repartition(5), "a", "b").collect()} == brute(edges, loops)
    assert find(df.limit(0), "a", "b").collect() == []


def test_leaf_groups(spark):
    folios = spark.createDataFrame([("f1r",), (" F008v",), ("f8v",), ("f9r2",), ("cover",), (None,), ("",)], "folio string")
    pairs = spark.createDataFrame([(1, 8), (8, 1), (8, 700), (9, 9), (None, 1), (700, None)], "leaf_a int, leaf_b int")
    assert {tuple(r) for r in splits.leaf_groups(folios, pairs).collect()} == {("f1r", 1, 1), ("f8v", 8, 1), ("f9r2", 9, 9)}
    assert splits.leaf_groups(folios, pairs.limit(0)).count() == 3


def test_unit_splits(spark):
    units = spark.createDataFrame([(f"u{i}", 10) for i in range(500)] + [("hot", 900)], "unit string, n long")
    got = splits.unit_splits(units, [("a", 0.8), ("b", 0.1), ("c", 0.1), ("d", None), ("e", 0.0)])
    shares = {r["split_name"]: r["n"] / 5900 for r in got.groupBy("split_name").agg(F.sum("n").alias("n")).collect()}
    assert set(shares) == {"a", "b", "c"} and abs(shares["a"] - 0.8) < 0.01 and abs(shares["b"] - 0.1) < 0.01
    assert got.where("unit = 'hot'").first()["split_name"] == "a"
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in splits.unit_splits(units.repartition(5), [("c", 0.1), ("b", 0.1), ("a", 0.8)]).collect()}
    assert splits.unit_splits(units.limit(0), [("a", 1.0)]).collect() == []


def test_proposal_splits_keep_together(spark):
    rows = [(i, f"f{i % 40}{'rv'[i % 2]}", i) for i in range(400)] + [(400, None, 1), (401, "cover", 1), (402, " Cover", 1), (None, "f1r", 1), (0, "f0r", 9999)]
    df = spark.createDataFrame(rows, "proposal_id long, folio string, t long").withColumn("ingested_at", F.timestamp_seconds("t"))
    pairs = spark.createDataFrame([(a, 39 - a) for a in range(20)], "leaf_a int, leaf_b int")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    got = {r["proposal_id"]: (r["unit"], r["split_name"]) for r in splits.proposal_splits(df, pairs, targets).collect()}
    assert len(got) == 403
    for i in range(400):
        assert got[i][0] == f"leaf:{min(i % 40, 39 - i % 40)}"
    assert got[401] == got[402] and len({u for u, _ in got.values()}) == len(set(got.values()))


def mix_of(spark, sizes, targets, total=None):
    s = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix, rates = mixing.mixed(s, t, total)
    return mix.collect(), {r["source"]: r for r in rates.collect()}, {r["source"]: r for r in mixing.mix_report(mix, rates, t).collect()}


def test_mix_reaches_shares_and_caps(spark):
    sizes = [(i, "big", 10 + i % 7) for i in range(2000)] + [(10_000 + i, "small", 10) for i in range(20)] + [(20_000, "none_asked", 10)]
    targets = [(" Big", 0.5, 2), ("small", 0.5, 3), ("gone", 0.2, 1), (None, 0.1, 1), ("bad", NAN, 1)]
    rows, rates, report = mix_of(spark, sizes, targets)
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(times[10_000 + i] == 3 for i in range(20)) and max(v for k, v in times.items() if k < 10_000) <= 2 and 20_000 not in times
    assert report["small"]["mixed_tokens"] == 600 and report["gone"]["mixed_tokens"] == 0
    assert abs(sum(r["tokens"] for r in rows) - sum(n for _, s, n in sizes if s != "none_asked")) < 60
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)


def test_mix_rates_are_systematic(spark):
    sizes = [(i, "a", 1 + i % 50) for i in range(1000)]
    rows, rates, report = mix_of(spark, sizes, [("a", 1.0, 5)], total=2.5 * sum(n for *_, n in sizes))
    assert rates["a"]["rate"] == pytest.approx(2.5) and abs(len(rows) - 2500) <= 1
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times.values()) <= {2, 3} and report["a"]["most_repeats"] == 3
    assert abs(report["a"]["mixed_tokens"] / (2.5 * sum(n for *_, n in sizes)) - 1) < 0.01


def test_mix_of_nothing(spark):
    rows, rates, report = mix_of(spark, [], [("a", 1.0, 2)])
    assert rows == [] and rates == {} and report["a"]["mixed_tokens"] == 0 and not math.isnan(report["a"]["actual_share"])


def test_source_forms(spark):
    got = [r["s"] for r in spark.createDataFrame([(" Folio-Survey",), ("folio survey ",), ("",), (None,)], "x string").select(mixing.source_form(F.col("x")).alias("s")).collect()]
    assert got == ["folio_survey", "folio_survey", None, None]
