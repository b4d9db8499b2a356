"""Neighbours and clusters against brute force."""

import numpy as np
import pytest

from quirework.llm import crossing, neighbours, spectral
from quirework.operators import pivots

KIND = "vec_id long, vec array<float>, id string, near int"


def vectors(n_groups=30, seed=1, hot=150):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        centre = rng.normal(size=64)
        for _ in range(hot if g == 0 else 1 + g % 9):
            rows.append((centre + rng.normal(size=64) * (0.05 + 0.2 * rng.random())) * rng.choice([0.3, 1.0, 4.0]))
    x = np.array(rows, np.float32)
    return rng.permutation(len(x)) + 10, x


def table(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in row], "x", 1) for i, row in zip(ids, x)]
    return spark.createDataFrame(rows + list(extra), KIND)


def cosines(ids, x):
    order = np.argsort(ids)
    u = x[order].astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return ids[order], s


def brute(ids, x, k, least):
    names, s = cosines(ids, x)
    return {int(names[i]): [int(names[j]) for j in np.lexsort((names, -s[i]))[:k] if s[i, j] >= least] for i in range(len(names))}


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["near"])
    return out


WRONG = [(1, None, "", 0), (2, [], "", 0), (3, [1.0] * 63, "", 0), (4, [0.0] * 64, "", 0), (5, [float("nan")] * 64, "", 0), (6, [float("inf")] + [1.0] * 63, "", 0), (7, [None] + [1.0] * 63, "", 0), (None, [1.0] * 64, "", 0)]


@pytest.mark.parametrize("block", [8192, 40])
def test_all_posted_is_exact(spark, block):
    ids, x = vectors()
    x[20] = x[21] = x[22]
    every = neighbours.Index(posted=16, pivots=0.1, block=block)
    repeated = [(int(ids[3]), [float(v) for v in x[3]], "again", 2)]
    got = found(neighbours.nearest(table(spark, ids, x, WRONG + repeated), 5, 0.82, index=every))
    assert got == {i: js for i, js in brute(ids, x, 5, 0.82).items() if js}


def test_many_copies_name_the_smallest(spark):
    x = np.tile(np.arange(1, 65, dtype=np.float32), (30, 1))
    got = found(neighbours.nearest(table(spark, np.arange(30), x), 5, 0.82))
    assert got[0] == [1, 2, 3, 4, 5] and got[29] == [0, 1, 2, 3, 4] and got[3] == [0, 1, 2, 4, 5]


def test_recall_of_the_defaults(spark):
    ids, x = vectors(400, 4)
    got, want = found(neighbours.nearest(table(spark, ids, x), 5, 0.82)), brute(ids, x, 5, 0.82)
    pairs = lambda d: {(i, j) for i, js in d.items() for j in js}
    assert len(pairs(got) & pairs(want)) / len(pairs(want)) > 0.97
    assert len(pairs(got) & pairs(want)) / len(pairs(got)) > 0.97


def test_recall_in_a_group_of_a_third(spark):
    rng = np.random.default_rng(7)
    centre, others = rng.normal(size=64), rng.normal(size=(400, 64))
    x = np.r_[centre + rng.normal(size=(2000, 64)) * 0.38, np.repeat(others, 10, 0) + rng.normal(size=(4000, 64)) * 0.3].astype(np.float32)
    ids = rng.permutation(len(x))
    many = neighbours.Index(pivots=3.0)  # as many in the group as the default has in a large table
    got, want = found(neighbours.nearest(table(spark, ids, x), 5, 0.82, index=many)), brute(ids, x, 5, 0.82)
    dense = {(int(i), j) for i in ids[:2000] for j in want[int(i)]}
    assert len(dense & {(i, j) for i, js in got.items() for j in js}) / len(dense) > 0.97


def test_footrule_cuts_only(spark):
    ids, x = vectors(60, 2)
    wide = found(neighbours.nearest(table(spark, ids, x), 5, 0.82))
    near = found(neighbours.nearest(table(spark, ids, x), 5, 0.82, index=neighbours.Index(reach=6)))
    pairs = lambda d: {(i, j) for i, js in d.items() for j in js}
    assert 0 < len(pairs(near)) <= len(pairs(wide))
    same = np.array([[1, 2, 3, 4]])
    assert pivots.footrule_similarity(same, same)[0] == 10 and pivots.footrule_similarity(same, same[:, ::-1])[0] == 1 + 2 + 2 + 1
    assert pivots.footrule_similarity(same, same + 9)[0] == 0


def test_one_id_with_several_vectors_counts_once(spark):
    ids, x = vectors(5, 3, 10)
    other = [(int(ids[0]), [float(v) for v in x[-1]], "", 0)]
    a = found(neighbours.nearest(table(spark, ids, x, other), 3, 0.5))
    assert a == found(neighbours.nearest(table(spark, ids, x, other).repartition(5), 3, 0.5))


def test_few_usable_rows_have_pivots(spark):
    ids, x = vectors(1, 3, 20)
    rows = pivots.usable_vectors(table(spark, ids, x), "vec_id", "vec", 64)
    assert len(pivots.choose_pivots(rows, 100_000_000, neighbours.Index())[0]) > 0


def test_empty(spark):
    empty = table(spark, np.zeros(0, int), np.zeros((0, 64)))
    assert neighbours.nearest(empty).collect() == [] and neighbours.near_pairs(neighbours.nearest(empty)).collect() == []
    assert spectral.closed_groups(empty).collect() == [] and spectral.described(empty.withColumnRenamed("id", "folio")).collect() == []
    assert neighbours.nearest(table(spark, np.zeros(0, int), np.zeros((0, 64)), WRONG)).collect() == []


def closed(ids, x, least=0.82, fewest=5):
    names, s = cosines(ids, x)
    near = s >= least
    out = set()
    for i in range(len(names)):
        group = np.flatnonzero(near[i] | (np.arange(len(names)) == i))
        if len(group) >= fewest and all((near[j] | (np.arange(len(names)) == j))[group].all() and near[j].sum() == len(group) - 1 for j in group):
            out.add((int(names[i]), int(names[group].min())))
    return out


def test_closed_groups(spark):
    ids, x = vectors(60, 8)
    ids, x = np.r_[ids, 9000, 9001], np.r_[x, [x[160] * 2], [x[160]]]
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 64))
    chain = np.array([a * (1 - t) + b * t for t in np.linspace(0, 1, 12)], np.float32)
    ids, x = np.r_[ids, 9100 + np.arange(12)], np.r_[x, chain]
    want = closed(ids, x)
    got = {(r["vec_id"], r["cluster_key"]) for r in spectral.closed_groups(table(spark, ids, x)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and not any(v >= 9100 for v, _ in got)


def pair_of_groups():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    g, h = q[0] + 0.05 * q[2:22], q[1] + 0.05 * q[22:42]
    m, v = q[0] + 0.45 * q[1], q[1] + 0.45 * q[0]
    return np.r_[g, [m], h, [v], q[50] + 0.05 * q[52:58]].astype(np.float32)


def test_a_single_link_outside_is_found(spark):
    x = pair_of_groups()
    _, s = cosines(np.arange(len(x)), x)
    assert (s[:21, 21:42] >= 0.7).sum() == 1
    least = float(s[20, 41]) - 0.001
    df = table(spark, np.arange(len(x)), x)
    labels = spark.createDataFrame([(i, 0 if i < 21 else 21 if i < 42 else 42) for i in range(len(x))], "id long, label long")
    got = spectral.closed(labels, spectral.affinities(df, least, "vec_id", "vec"), least)
    assert {r["id"] for r in got.collect()} == set(range(42, 48))
    assert {r["vec_id"] for r in spectral.closed_groups(df, least).collect()} <= set(range(42, 48))


@pytest.mark.parametrize("above", [1e-5, -1e-5])
def test_links_at_the_limit_are_decided_exactly(spark, above):
    x = pair_of_groups()
    _, s = cosines(np.arange(len(x)), x)
    least = float(s[20, 41]) + above  # the stored 16 bits can't tell
    df = table(spark, np.arange(len(x)), x)
    labels = spark.createDataFrame([(i, 0 if i < 21 else 21 if i < 42 else 42) for i in range(len(x))], "id long, label long")
    found = spectral.affinities(df, least, "vec_id", "vec")
    assert (20, 41) in {(r["lo"], r["hi"]) for r in found.doubts.collect()}
    got = {r["id"] for r in spectral.closed(labels, found, least).collect()}
    assert (20 in got) == (above > 0) == (41 in got) or (s[:21, :21] + np.eye(21) * 9 < least).any()
    assert {42, 47} <= got


@pytest.mark.parametrize("pivots, block", [(0.25, 8192), (9.0, 8192), (9.0, 16)])
def test_closed_whatever_the_lists(spark, pivots, block):
    ids, x = vectors(40, 8, 60)
    least, df = 0.82, table(spark, ids, x)
    want = closed(ids, x, least)
    label = dict(want) | {int(i): int(i) for i in ids if int(i) not in dict(want)}
    labels = spark.createDataFrame(list(label.items()), "id long, label long")
    index = neighbours.Index(posted=2, pivots=pivots, narrow=True, block=block, spread=2.0)  # many pivots: lists that not all members share
    got = spectral.closed(labels, spectral.affinities(df, least, "vec_id", "vec", index), least, index)
    assert {(r["id"], r["cluster_key"]) for r in got.collect()} == want


MOVED = 12  # times the bytes of the vectors that may be shuffled for the closed groups


def wide_groups(n_groups=150, seed=5):
    """Groups whose members are just over the limit to each other, so that many share no list, and some with one outsider."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        centre = rng.normal(size=64)
        x = centre / np.linalg.norm(centre) + rng.normal(size=(5 + g % 4, 64)) * 0.05
        rows += [*x] if g % 3 else [*x, 1.6 * x[0] - 0.6 * x[1]]
    return rng.permutation(len(rows)), np.array(rows, np.float32)


def test_closed_groups_are_whole_though_lists_part_them(spark):
    ids, x = wide_groups()
    want = closed(ids, x)
    assert len(want) > 300
    assert {(r["vec_id"], r["cluster_key"]) for r in spectral.closed_groups(table(spark, ids, x)).collect()} == want


@pytest.mark.parametrize("few, part", [(4000, 4096), (0, 4096), (0, 3)])
def test_crossing_pieces(spark, monkeypatch, few, part):
    monkeypatch.setattr(crossing, "FEW", few)
    monkeypatch.setattr(crossing, "PART", part)
    rng = np.random.default_rng(8)
    ids, x = vectors(40, 8, 30)
    piece = {int(i): int(p) for i, p in zip(ids, rng.integers(1000, 1400, len(ids)))}
    open_ = {p: p % 5 == 0 for p in piece.values()}
    names, s = cosines(ids, x)
    pairs = {(piece[int(names[i])], piece[int(names[j])]) for i, j in zip(*np.nonzero(s >= 0.82))}
    want = {frozenset(p) for p in pairs if p[0] != p[1] and not (open_[p[0]] and open_[p[1]])}
    members = spark.createDataFrame([(i, p, open_[p], list(piece.values()).count(p)) for i, p in piece.items()], "id long, piece long, open boolean, size long")
    rows = table(spark, np.r_[ids, ids[:5]], np.r_[x, x[:5]]).selectExpr("vec_id AS id", "vec")
    got = crossing.crossing(rows, members, len(piece), 0.82, 64).collect()
    assert len(want) > 50 and {frozenset((r["piece"], r["other"])) for r in got} == want


@pytest.mark.parametrize("labelled", ["all alike", "at random"])
def test_closed_though_labels_are_wrong_and_cut(spark, monkeypatch, labelled):
    monkeypatch.setattr(crossing, "FEW", 0)
    monkeypatch.setattr(crossing, "PART", 16)
    ids, x = wide_groups(60)
    ids, x = np.r_[ids, 9000 + np.arange(50)], np.r_[x, np.ones((50, 64), np.float32) + np.random.default_rng(2).normal(size=(50, 64)).astype(np.float32) * 0.03]
    want = closed(ids, x)
    rng = np.random.default_rng(3)
    labels = spark.createDataFrame([(int(i), 0 if labelled == "all alike" else int(rng.integers(9))) for i in ids[:-20]], "id long, label long")
    got = spectral.closed(labels, spectral.affinities(table(spark, np.r_[ids, ids[:9]], np.r_[x, x[:9]]), 0.82, "vec_id", "vec"), 0.82)
    assert len(want) > 150 and {(r["id"], r["cluster_key"]) for r in got.collect()} == want


def test_vectors_are_moved_a_few_times_only(spark):
    ids, x = wide_groups(2000)
    df = table(spark, ids, x)
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda s: (s.apply(i) for i in range(s.size())))(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large to be broadcast
    try:
        before = shuffled()
        assert spectral.closed_groups(df).count() > 4000
        assert (shuffled() - before) / (x.size * 4) < MOVED
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_outsider_just_under_the_limit_parts_no_group(spark):
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(64, 64)))[0]
    x = np.r_[[q[0]], 0.82 * q[0] + np.sqrt(1 - 0.82**2) * q[1] + 0.2 * q[2:12]].astype(np.float32)
    _, s = cosines(np.arange(11), x)
    least = round(float(s[0, 1:].max()) + 2e-5, 6)  # the stored 16 bits can't tell that none is similar to the smallest id
    assert s[1:, 1:][~np.eye(10, dtype=bool)].min() > least + 0.01
    got = spectral.closed_groups(table(spark, np.arange(11), x), least).collect()
    assert {(r["vec_id"], r["cluster_key"]) for r in got} == {(i, 1) for i in range(1, 11)}


def test_copies_beyond_a_few_follow_the_smallest(spark):
    ids, x = vectors(12, 5, 30)
    x = np.r_[x, np.repeat(x[40:41], 300, 0)]
    ids = np.r_[ids, 5000 + np.arange(300)]
    df = table(spark, ids, x)
    assert {(r["vec_id"], r["cluster_key"]) for r in spectral.closed_groups(df).collect()} == closed(ids, x)
    ready = neighbours.prepared(df, "vec_id", "vec", neighbours.Index(), 6)
    assert ready.rows.count() == len(ids) - 295 and ready.excess.count() == 295 and ready.rows.agg({"weight": "sum"}).first()[0] == len(ids)
    every = neighbours.Index(posted=16, pivots=0.1)
    assert found(neighbours.nearest(df, 5, 0.82, index=every)) == {i: js for i, js in brute(ids, x, 5, 0.82).items() if js}
    top = max(spectral.described(df.withColumnRenamed("id", "folio")).collect(), key=lambda r: r["size"])
    assert top["size"] > 300 and len(top["typical"]) == 5


def test_described(spark):
    ids, x = vectors(20, 5, 60)
    df = table(spark, ids, x).withColumnRenamed("id", "folio")
    rows = spectral.described(df).collect()
    u = {int(i): v / np.linalg.norm(v) for i, v in zip(ids, x.astype(np.float64))}
    top = max(rows, key=lambda r: r["size"])
    assert top["size"] == 60 and len(top["typical"]) == 5 and top["distinct_folios"] == 1 and top["top_folios"][0]["n"] == 60
    members = [u[int(i)] for i in ids[:60]]
    centre = np.mean(members, 0) / np.linalg.norm(np.mean(members, 0))
    assert top["mean_centroid_cosine"] == pytest.approx(np.mean([m @ centre for m in members]), abs=1e-5)


def test_typical_are_the_members_most_alike_to_all(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=64) + rng.normal(size=(60, 64)) * np.linspace(0.4, 0.05, 60)[:, None]).astype(np.float32)
    top = max(spectral.described(table(spark, np.arange(60), x).withColumnRenamed("id", "folio")).collect(), key=lambda r: r["size"])
    assert top["size"] == 60
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert top["typical"] == np.lexsort((np.arange(60), -np.round(u @ u.sum(0), 6)))[:5].tolist()


def test_no_point_has_a_nearer_centre(spark):
    rng = np.random.default_rng(12)
    pairs = {(min(a, b), max(a, b)) for a, b in zip(rng.integers(0, 300, 500).tolist(), rng.integers(0, 300, 500).tolist()) if a != b}
    assert spectral.ROUNDS >= 6 and spectral.TOUCHING <= 0.3  # fewer and wider merge unlike centres by chance
    links = spark.createDataFrame([(a, b, 820_000 + (a * b) % 180_000) for a, b in sorted(pairs)], "lo long, hi long, micro long")
    label = {r["id"]: r["label"] for r in spectral.clusters(links).collect()}
    assert label == {r["id"]: r["label"] for r in spectral.clusters(links.repartition(3)).collect()}
    at = {r["id"]: np.array([r[c] / spectral.ONE for c in spectral.X]) for r in spectral.embedding(links).points.collect()}
    assert set(at) == set(label) == {i for p in pairs for i in p}
    centre = {c: np.mean([at[i] for i in at if label[i] == c], 0) for c in set(label.values())}
    assert sum(label[a] != label[b] for a, b in pairs) > 0
    for a, b in pairs:
        for i, other in ((a, label[b]), (b, label[a])):
            assert np.linalg.norm(at[i] - centre[label[i]]) <= np.linalg.norm(at[i] - centre[other]) + 1e-8


def test_larger_clusters_are_described_in_blocks(spark):
    ids, x = vectors(3, 6, 90)
    df = table(spark, ids, x).withColumnRenamed("id", "folio")
    whole, cut = ({r["cluster_key"]: r for r in spectral.described(df, block=b).collect()} for b in (8192, 20))
    assert whole == cut and max(r["size"] for r in whole.values()) == 90
