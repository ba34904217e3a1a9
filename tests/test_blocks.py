"""Block products, lasso penalties, forests, factorisations, selection and the regressor against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import kernels
from cohortloom.functions.nonneg import nonnegative
from cohortloom.operators import cohort, factor, forest, gram, lasso, network, pairs, perceptron


def long(spark, x, **columns):
    """x (NaN: absent) as a long matrix, with further columns by sample."""
    rows = [(int(i), f"f{j:03d}", None if np.isnan(v) and (i + j) % 2 else float(v), *(c[i] for c in columns.values())) for i, row in enumerate(x) for j, v in enumerate(row) if not np.isnan(v) or (i + j) % 2]
    kinds = "".join(f", {n} {'string' if isinstance(c[0], str) else 'long'}" for n, c in columns.items())
    return spark.createDataFrame(rows, "sample_id long, feature_id string, value double" + kinds).repartition(3)


def holes(rng, n, p):
    x = rng.normal(size=(n, p)) + 50
    x[:, 3] += 2 * x[:, 1]
    x[rng.random((n, p)) < 0.1] = np.nan
    x[:, 4] = 7.1
    return x


@pytest.mark.parametrize("width", [512, 3])
def test_correlations_over_the_samples_that_have_both(spark, width):
    x = holes(np.random.default_rng(0), 40, 8)
    got = {(r["i"], r["j"]): r["r"] for r in gram.correlations(long(spark, x), width).collect()}
    assert len(got) == 28
    for (i, j), r in got.items():
        a, b = x[:, int(i[1:])], x[:, int(j[1:])]
        both = ~np.isnan(a) & ~np.isnan(b)
        if "f004" in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)


def test_sums_by_group_and_set(spark, monkeypatch):
    monkeypatch.setattr(gram, "HELD", 200)  # many partial sums
    rng = np.random.default_rng(1)
    x, grp = rng.normal(size=(30, 3)), [f"g{i % 2}" for i in range(30)]
    found, names, low = gram.moments(long(spark, x, grp=grp), ["grp"], F.shiftleft(F.lit(1).cast("long"), 1), 2)
    rows = {(r["grp"], r["set"]): r for r in found.collect()}
    assert set(rows) == {(g, s) for g in ("g0", "g1") for s in (-1, 1)}  # nobody is in set 0
    own = x[[g == "g1" for g in grp]]
    n, sa, _, _, _, sab = gram.shaped([rows["g1", -1][s] for s in gram.SUMS], (3, 3))
    assert n[0, 0] == 15 and np.allclose(sab - sa * sa.T / 15, 15 * np.cov(own.T, bias=True))


@pytest.mark.parametrize("width", [512, 4])
def test_square_of_a_symmetric_matrix(spark, width):
    rng = np.random.default_rng(2)
    a = rng.random((10, 10))
    a = np.triu(np.where(a < 0.5, 0, a), 1)
    a = a + a.T
    a[0, 1:] = a[1:, 0] = 0.2  # every node occurs
    cells = spark.createDataFrame([(f"n{i}", f"n{j}", float(a[i, j])) for i in range(10) for j in range(10) if a[i, j]], "i string, j string, v double")
    got = {(r["i"], r["j"]): r["v"] for r in gram.squared(cells, width).collect()}
    assert len(got) == 45 and all(v == pytest.approx((a @ a)[int(i[1:]), int(j[1:])]) for (i, j), v in got.items())


def test_subsamples_have_their_exact_size(spark):
    ids = spark.createDataFrame([(i, i % 2) for i in range(101)], "sample_id long, grp int")
    bits = lasso.subsample_bits(ids, ["grp"], 6, 0.8).collect()
    assert len(bits) == 101
    for g, n in ((0, 51), (1, 50)):
        for s in range(6):
            assert sum(r["member"] >> s & 1 for r in bits if r["grp"] == g) == int(0.8 * n)
    assert len({r["member"] for r in bits}) > 20


def chain(rng, n):
    x = rng.normal(size=(n, 6))
    for j in (1, 2, 3):
        x[:, j] = 0.97 * x[:, j - 1] + 0.24 * x[:, j]
    return x


def test_lasso_arms_by_size(spark):
    rng = np.random.default_rng(3)
    sizes = {"none": 39, "stars": 60, "cv": 150}
    x, grp = np.concatenate([chain(rng, n) for n in sizes.values()]), [g for g, n in sizes.items() for _ in range(n)]
    edges = lasso.networks(long(spark, x, grp=grp), ["grp"]).collect()
    assert {(r["grp"], r["method"]) for r in edges} == {("stars", "StARS"), ("cv", "CV")}
    for g in ("stars", "cv"):
        strong = {(r["i"], r["j"]) for r in sorted((r for r in edges if r["grp"] == g), key=lambda r: -r["weight"])[:3]}
        assert strong == {("f000", "f001"), ("f001", "f002"), ("f002", "f003")}


def test_cross_validation_is_that_of_dense_folds(spark):
    x = chain(np.random.default_rng(4), 90)
    nets = lasso.folded(long(spark, x), [])
    fold = {r["sample_id"]: r["b"].bit_length() - 1 for r in spark.range(90).select(F.col("id").alias("sample_id"), lasso.fold_bits(F.col("id")).alias("b")).collect()}
    fold = np.array([fold[i] for i in range(90)])
    assert set(fold) == set(range(5))
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)

    def score(alpha):
        out = []
        for f in range(5):
            fit = kernels.graphical_lasso(np.cov(z[fold != f].T, bias=True), alpha, steps=500, tol=1e-4)
            out.append(lasso.likelihood(np.cov(z[fold == f].T, bias=True), fit))
        return np.mean(out)

    alpha = lasso.cross_validated(nets)[()]
    s = np.abs(np.corrcoef(x.T) - np.eye(6)).max()
    assert score(alpha) >= max(score(a) for a in np.logspace(np.log10(s), np.log10(s / 100), 12)) - 2e-3


def test_penalty_before_the_first_unstable(spark):
    path = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.5, 0.04), ("a", 0.2, 0.06), ("a", 0.1, 0.01), ("b", 1.0, 0.2), ("b", 0.5, 0.0)], "grp string, lambda double, instability double")
    assert {tuple(r) for r in lasso.stable_penalty(path, ["grp"]).collect()} == {("a", 0.5), ("b", 1.0)}


def test_failed_fits_fall_back(spark, monkeypatch):
    assert kernels.graphical_lasso(np.array([[1.0, np.nan], [np.nan, 1.0]]), 0.1) is None
    nets = lasso.Networks(long(spark, chain(np.random.default_rng(5), 50)), [], None, 0)
    one = lasso.edges_of(nets, {(): [float("nan"), 0.1]}, "StARS").collect()
    assert one and one == lasso.edges_of(nets, {(): [0.1]}, "StARS").collect()
    assert lasso.edges_of(nets, {(): [float("nan")]}, "StARS").collect() == []


def test_forest_finds_the_cause_and_its_first_split(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 6))
    x[:, 5] = np.where(x[:, 2] > 0.3, 3, 0) + 0.1 * rng.normal(size=700)
    m = long(spark, x)
    imp = {(r["i"], r["j"]): r["w"] for r in forest.importances(m, trees=12).collect()}
    into = {i: w for (i, j), w in imp.items() if j == "f005"}
    assert max(into, key=into.get) == "f002" and sum(into.values()) == pytest.approx(1, abs=1e-2)
    assert all(i != j for i, j in imp) and imp == pytest.approx({(r["i"], r["j"]): r["w"] for r in forest.importances(m.repartition(1), trees=12).collect()})
    first = {r["target"]: r for r in forest.first_splits(m).collect()}
    assert first["f005"]["feature"] == "f002" and first["f002"]["feature"] == "f005"


def test_forest_shuffles_samples_not_sums(spark, monkeypatch):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    m = long(spark, np.random.default_rng(8).normal(size=(1000, 6))).persist()
    table = forest.Table(m)
    before = written()
    grown = forest.levels(table, trees=20, depth=4)
    assert written() - before < 1000 * 1000  # a sample's cells, not its trees, candidates and bins
    monkeypatch.setattr(forest, "CHUNK", 100)  # many blocks are as one
    assert all(np.array_equal(a, b) for x, y in zip(grown, forest.levels(table, trees=20, depth=4)) for a, b in zip(x[:2], y[:2]))


def test_one_tree_is_that_of_plain_recursion(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    table = forest.Table(long(spark, x))
    grown = forest.levels(table, trees=1, depth=4, many=4, bootstrap=False)
    bins = table.bins(x)

    def split(rows, level, node):
        feature, cut, gain = (v[3, 0, node] for v in grown[level])
        y = x[rows, 3]
        best = max((((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)), -f, -b) for f in range(3) for b in range(forest.BINS - 1) if 0 < (left := bins[rows, f] <= b).sum() < len(rows)), default=(0,))
        if best[0] <= 1e-12:
            assert feature == -1
            return
        assert gain == pytest.approx(best[0]) and (feature, cut) == (-best[1], -best[2])
        if level < 3:
            go = bins[rows, feature] <= cut
            split(rows[go], level + 1, 2 * node)
            split(rows[~go], level + 1, 2 * node + 1)

    split(np.arange(300), 0, 0)


def test_batched_least_squares_meet_their_optimality_conditions():
    rng = np.random.default_rng(8)
    for k in (1, 3, 6):
        a, b = rng.normal(size=(9, k)), rng.normal(size=(50, 9))
        x = nonnegative(a.T @ a, b @ a)
        g = (b - x @ a.T) @ a
        assert (x >= 0).all() and (g <= 1e-8).all() and np.abs(g[x > 1e-9]).max() < 1e-8
    twice = np.array([[1.0, 1.0], [2.0, 2.0]])  # dependent columns
    x = nonnegative(twice.T @ twice, np.array([[3.0, 6.0]]) @ twice)
    assert np.allclose(twice @ x[0], [3, 6])
    assert not nonnegative(np.zeros((2, 2)), np.zeros((3, 2))).any()


def test_factorisations_never_get_worse_and_reach_an_exact_one(spark):
    rng = np.random.default_rng(9)
    w = rng.random((60, 2)) * np.where(np.arange(60)[:, None] % 2 == [0, 1], 1, 0.05)
    x = w @ rng.random((2, 7))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, features array<double>").repartition(3)
    blocks, hs, errors = factor.factorised(rows, (2, 3), 3, steps=200, tol=1e-9)
    assert set(hs) == {(k, r) for k in (2, 3) for r in range(4)}
    assert all(b <= a + 1e-9 for e in errors.values() for a, b in zip(e, e[1:]))
    assert all(e[-1] < 1e-3 * (x * x).sum() for e in errors.values())
    for n, h in hs.items():
        assert errors[n][-1] == pytest.approx(((x - factor.scores(x, h) @ h) ** 2).sum(), abs=1e-6)
    labels = {r["sample_id"]: r["labels"] for r in factor.label_arrays(blocks, hs, "bigint").where("k = 2").collect()}
    assert len(labels) == 60 and all(len(v) == 4 for v in labels.values())
    for r in range(4):  # a run tells the two kinds of samples apart, under either number
        same = np.mean([labels[i][r] == i % 2 for i in range(60)])
        assert same > 0.9 or same < 0.1
    assert factor.factorised(rows.limit(0), (2,), 1)[1] == {}


def test_agreement_of_classes_is_that_of_samples(spark):
    rng = np.random.default_rng(10)
    kinds = rng.integers(0, 3, (7, 5))
    labels = kinds[rng.integers(0, 7, 40)]
    runs = spark.createDataFrame([(r, i, int(labels[i, r])) for i in range(40) for r in range(5)], "run int, sample_id int, label int")
    share = {(r["i"], r["j"]): r["share"] for r in cohort.consensus_matrix(runs).collect()}
    want = {(i, j): (labels[i] == labels[j]).sum() / 6 for i in range(40) for j in range(i + 1, 40)}
    assert share == pytest.approx({p: s for p, s in want.items() if s})
    arrays = spark.createDataFrame([(2, i, labels[i].tolist()) for i in range(40)], "k int, sample_id int, labels array<int>")
    named, members = factor.classes(arrays, ["k"])
    assert members.count() == 40 and named.agg(F.sum("size")).first()[0] == 40 and named.count() == len(np.unique(labels, axis=0))
    got = factor.agreement(named, factor.class_shares(named, ["k"], size=3)).first()
    d = np.array([[1 - np.mean(a == b) for b in labels] for a in labels])
    upper = np.triu_indices(40, 1)
    assert got["cophenetic"] == pytest.approx(np.corrcoef(d[upper], kernels.cophenetic(d)[upper])[0, 1])
    assert got["min_cluster"] == min(np.unique(labels[:, 0], return_counts=True)[1])


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "tiny"])
def test_top_share_is_a_ranking(spark, kind):
    rng = np.random.default_rng(11)
    w = {"plain": rng.random(4000), "ties": rng.integers(1, 4, 4000) / 4, "one": np.full(4000, 0.5), "tiny": np.where(rng.random(4000) < 0.5, 0.3, np.nextafter(0.3, 1))}[kind]
    rows = [(int(k // 80), int(k % 80), float(v)) for k, v in enumerate(w)]
    df = spark.createDataFrame(rows, "i int, j int, w double").repartition(4)
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:200]
    assert sorted(tuple(r) for r in network.top_share(df, "w").collect()) == sorted(want)
    assert network.top_share(df.limit(19), "w").count() == 0


def test_neighbour_weights_sum_to_the_logarithm(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :6]
    near = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(40) for j in order[i]], "i int, j int, d double")
    got = {(r["i"], r["j"]): r["w"] for r in pairs.fuzzy_weights(near, 6).collect()}
    assert all(0 < w <= 1 and got[j, i] == w for (i, j), w in got.items())
    one_way = np.zeros((40, 40))
    for i in range(40):
        e = d[i, order[i]] - d[i, order[i]].min()
        lo, hi = 0.0, 100.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-e / mid).sum() > np.log2(6) else (mid, hi)
        one_way[i, order[i]] = np.exp(-e / hi)
    whole = one_way + one_way.T - one_way * one_way.T
    assert got == pytest.approx({(i, j): whole[i, j] for i in range(40) for j in range(40) if whole[i, j] > 0}, abs=1e-6)
    same = pairs.fuzzy_weights(spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], "i int, j int, d double"), 6).collect()
    assert {tuple(r) for r in same} == {(1, 2, 1.0), (2, 1, 1.0)}


def test_regressor_gradients_and_fit(spark):
    rng = np.random.default_rng(13)
    x, layers = rng.normal(size=(20, 3)), perceptron.start([3, 5, 4, 1], 1)
    y = x[:, 0] ** 2 - x[:, 1]
    grads = perceptron.gradients(layers, x, y)
    flat = [p for layer in layers for p in layer]
    for p, g in zip(flat, grads):
        for at in list(np.ndindex(p.shape))[:6]:
            held, step = p[at], 1e-6
            p[at] = held + step
            above = perceptron.loss(layers, x, y)
            p[at] = held - step
            below = perceptron.loss(layers, x, y)
            p[at] = held
            assert g[at] == pytest.approx((above - below) / (2 * step), abs=1e-4)
    assert grads[-1] == 20
    x = rng.normal(size=(400, 3))
    rows = [([float(v) for v in r], float(r[0] - 2 * r[1])) for r in x] + [(None, 1.0), ([0.0] * 3, None)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(3)
    fit = perceptron.train(df, "x", "y", steps=150)
    scored = perceptron.predict(df, fit, "x")
    assert scored.where("x is null").first()["prediction"] is None
    got = perceptron.mean_squared_error(scored, "prediction", "y").first()
    assert got["n"] == 400 and got["mse"] < 0.1


def test_networks_without_edges_beside_others(spark):
    x = np.random.default_rng(5).normal(size=(80, 2))
    rows = [(f"g{g}", s, f, float(x[s, 0] if g % 2 else x[s, f])) for g in range(10) for s in range(80) for f in range(2)]
    m = spark.createDataFrame(rows, "grp string, sample_id int, feature_id int, value double")
    assert sorted(r["grp"] for r in lasso.fixed(m, ["grp"], 0.5).collect()) == ["g1", "g3", "g5", "g7", "g9"]


def test_networks_have_all_features_of_their_vectors(spark, tmp_path):
    from cohortloom.plans import graph_queries

    x = np.random.default_rng(6).normal(size=(120, 67))
    x[:, 66] = x[:, 65] + 0.1 * x[:, 66]
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = graph_queries.glasso_networks(spark, str(tmp_path)).where("i = 65 and j = 66").collect()
    assert [r["grp"] for r in got] == ["large"]


def test_average_linkage_of_more_classes_than_one_table_holds(spark, monkeypatch):
    labels = np.random.default_rng(11).integers(0, 3, (30, 400))
    labels = np.concatenate([labels, labels[:7], labels[:3]])
    arrays = spark.createDataFrame([(3, i, r.tolist()) for i, r in enumerate(labels)], "k int, sample_id int, labels array<int>")
    named = factor.classes(arrays, ["k"])[0].persist()
    d = np.array([[1 - np.mean(a == b) for b in labels] for a in labels])
    upper = np.triu_indices(40, 1)
    monkeypatch.setattr(factor, "MOST_CLASSES", 6)
    got = factor.agreement(named, factor.class_shares(named, ["k"])).first()
    assert got["cophenetic"] == pytest.approx(np.corrcoef(d[upper], kernels.cophenetic(d)[upper])[0, 1])
    assert got["min_cluster"] == min(np.unique(labels[:, 0], return_counts=True)[1])


def test_pairs_of_many_classes_are_not_listed(spark, sf, monkeypatch):
    from cohortloom.plans import kernel_queries

    monkeypatch.setattr(factor, "MOST_CLASSES", 6)
    asked, shares = [], factor.class_shares
    monkeypatch.setattr(factor, "class_shares", lambda named, by: asked.append(named) or shares(named, by))
    got = kernel_queries.cophenetic(spark, sf, ks=(2, 3), runs=5).collect()
    assert sorted(r["k"] for r in got) == [2, 3]
    assert all(r["count"] <= 6 for r in asked[0].groupBy("k").count().collect())


def test_consensus_of_one_large_class_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(cohort, "BLOCK", 8)
    runs = spark.range(60).crossJoin(spark.range(2).withColumnRenamed("id", "run")).selectExpr("run", "id as sample_id", "cast(id div 55 as long) as label")
    got = cohort.consensus_matrix(runs, 2).selectExpr("*", "spark_partition_id() as part").collect()
    want = {(i, j): 0.67 for i in range(60) for j in range(i + 1, 60) if i // 55 == j // 55}
    assert len(got) == len(want) and {(r["i"], r["j"]): r["share"] for r in got} == want
    assert len({r["part"] for r in got}) > 2


def test_consensus_in_arrays_is_that_of_rows(spark, monkeypatch):
    monkeypatch.setattr(cohort, "BLOCK", 8)
    runs = spark.range(40).crossJoin(spark.range(3).withColumnRenamed("id", "run")).selectExpr("run", "id as sample_id", "cast(id * (run + 2) div 5 % 3 as long) as label")
    rows = cohort.consensus_matrix(runs.withColumn("sample_id", F.format_string("%03d", "sample_id")), 6).selectExpr("int(i)", "int(j)", "share")
    found = cohort.consensus_matrix(runs, 6)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
