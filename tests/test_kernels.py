import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import kernels
from cohortloom.operators import cohort, deconv, matrix, network, stats


def test_cophenetic_of_a_small_tree():
    d = np.array([[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]], float)
    assert np.allclose(kernels.cophenetic(d), d)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    x[:, 1] += x[:, 0]
    s = np.cov(x.T, bias=True)
    theta = kernels.graphical_lasso(s, 0.1, steps=300, tol=1e-9)
    g = np.linalg.inv(theta) - s
    off = ~np.eye(6, dtype=bool)
    assert (np.abs(g[off]) <= 0.1 + 1e-4).all() and np.allclose(g[off & (theta != 0)], 0.1 * np.sign(theta[off & (theta != 0)]), atol=1e-4)


def test_betweenness_of_a_path_and_of_equal_ways():
    path = kernels.betweenness([1, 2, 3], [(1, 2, 1.0), (2, 3, 1.0)])
    assert path == {1: 0.0, 2: 0.5, 3: 0.0}
    two = kernels.betweenness("abcd", [("a", "b", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0)])
    assert two["b"] == two["c"] == pytest.approx(0.5 / 6)


def test_imputation_arms(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (3, "a", 5.0), (3, "b", 9.0)], "sample_id int, feature_id string, value double")
    assert [tuple(r) for r in matrix.knn_impute(m).collect()] == [(2, "b", 2.0)]  # a donor at distance zero takes all


def test_ranks_of_constant_and_single_class(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "y int, s double")
    assert stats.auroc(df, "y", "s").first()["auroc"] == 0.5
    flat = spark.createDataFrame([(float(i), 1.0) for i in range(6)], "x double, y double")
    assert stats.spearman(flat, "x", "y").first()["rho"] is None


def test_constant_feature_and_repeated_cell(spark):
    m = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0)], "sample_id int, feature_id string, value double")
    assert {r["value"] for r in matrix.zscore(m).collect()} == {0.0}
    with pytest.raises(Exception, match="repeated cell"):
        matrix.pivot(m.unionAll(m), ["a"]).collect()


def test_choices(spark):
    k = spark.createDataFrame([(2, 0.9, 20), (3, 0.95, 5), (4, 0.85, 20)], "k int, cophenetic double, min_cluster int")
    assert cohort.select_k(k).first()["k"] == 2
    path = spark.createDataFrame([(1.0, 0.0), (0.5, 0.01), (0.2, 0.3), (0.1, 0.0)], "lambda double, instability double")
    assert cohort.running_lambda(path).first()["lambda"] == 0.5
    e = spark.createDataFrame([(i, i + 1, 0.1 * i) for i in range(1, 41)], "i int, j int, w double")
    assert network.top_share(e, "w").count() == 2
    high = spark.createDataFrame([(1.0, 0.2), (0.5, 0.0)], "lambda double, instability double")
    assert cohort.running_lambda(high).first()["lambda"] == 1.0  # the largest stays though it is unstable


def test_steps_run_and_stop_at_the_first_failure(spark, tmp_path):
    from cohortloom.plans import steps
    from cohortloom.sources import io

    m, c, cells = io.synthetic_matrix(spark, 12, 8), io.synthetic_clinical(spark, 12), io.synthetic_cells(spark, 40, 8)
    steps.preprocess(m.cache(), c.cache())["matrix"].write.parquet(str(tmp_path / "m"))  # stored between steps, which keeps plans short
    ready = spark.read.parquet(str(tmp_path / "m"))
    assert ready.count() == 96 and ready.where("value is null").count() == 0
    bulk = m.where("value is not null").withColumn("feature_id", F.regexp_replace("feature_id", "PROT", "GENE"))
    got = steps.deconvolve(bulk, cells)["proportions"].groupBy("sample_id").agg(F.round(F.sum("proportion"), 6).alias("s")).collect()
    assert {r["s"] for r in got} == {1.0} and steps.deconvolve(bulk, None)["status"] == "SKIPPED"
    assert steps.coexpression(ready, 8, 0.0)["edges"].count() == 28
    master = c.withColumn("subtype", F.col("diagnosis")).withColumn("dpt", F.col("age_death") / 100.0)
    assert steps.validate(master)["sizes"].count() == 2
    done = steps.run_all([("a", lambda d: {"status": "PASS"}), ("b", lambda d: 1 / 0), ("c", lambda d: {"status": "PASS"})])
    assert [x["status"] for x in done.values()] == ["PASS", "FAIL"]


def test_tails():
    from cohortloom.functions.pvalues import chi2_tail

    # table values of the chi-squared distribution at 5 %
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.067140)):
        assert chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def test_mann_whitney_by_hand(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 5.0), (1, 6.0)], "g int, v double")
    r = stats.mann_whitney_test(df, "g", "v", 0, 1).first()
    assert r["u"] == 0 and r["z"] == pytest.approx(-4 / 5.25**0.5) and r["p"] == pytest.approx(0.1)  # exact: 2 of 20 orders
    assert stats.mann_whitney_test(df, "g", "v", 0, 1, exact_up_to=0).first()["p"] == pytest.approx(0.0809, abs=1e-4)


def test_exact_mann_whitney(spark):
    from itertools import combinations

    from cohortloom.functions.pvalues import mann_whitney_exact

    for n1, n2 in ((3, 3), (2, 5), (4, 3)):
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        for u in set(us):
            far = min(u, n1 * n2 - u)
            assert mann_whitney_exact(u, n1, n2) == pytest.approx(min(1, 2 * sum(x <= far for x in us) / len(us)))
    tied = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 4.0)], "g int, v double")
    r = stats.mann_whitney_test(tied, "g", "v", 0, 1).first()
    assert r["p"] == pytest.approx(np.vectorize(__import__("math").erfc)(abs(r["z"]) / 2**0.5))


@pytest.mark.parametrize("rows_a_range", [1 << 16, 100])
def test_running_sums_are_brute_force(spark, rows_a_range, monkeypatch):
    monkeypatch.setattr(stats, "ROWS", rows_a_range)
    rng = np.random.default_rng(7)
    rows = sorted({(int(g), float(v)): int(n) for g, v, n in zip(rng.integers(0, 3, 4000), rng.normal(size=4000).round(3), rng.integers(1, 9, 4000))}.items())
    df = spark.createDataFrame([(None if g == 2 else g, v, n) for (g, v), n in rows], "g int, v double, n long")
    got = {(r["g"], r["v"]): r["s"] for r in stats.running_sums(df, "v", {"s": F.col("n")}, ["g"]).collect()}
    total = {}
    for (g, v), n in rows:
        assert got[(None if g == 2 else g, v)] == total.get(g, 0)
        total[g] = total.get(g, 0) + n
    alone = stats.running_sums(df.limit(0), "v", {"s": F.col("n")})
    assert alone.count() == 0


def test_split_is_a_ranking(spark):
    df = spark.range(0, 40_000, 3).withColumnRenamed("id", "k")
    got = {r["k"]: r["train"] for r in network.split(df, "k", 4).collect()}
    order = sorted(got, key=lambda i: (i * 9 % 10007, i))
    assert [got[i] for i in order] == [True] * int(0.7 * len(order)) + [False] * (len(order) - int(0.7 * len(order)))


def test_small_choices_of_samples_features_and_controls(spark):
    m = spark.createDataFrame([(s, f, float(s * f)) for s in range(5) for f in range(4)], "sample_id int, feature_id int, value double")
    assert {r["sample_id"] for r in matrix.head_samples(m, 2).collect()} == {0, 1} and {r["feature_id"] for r in matrix.first_features(m, 3).collect()} == {0, 1, 2}
    assert matrix.prefilter(m, 4) is m and {r["feature_id"] for r in matrix.prefilter(m, 2).collect()} == {2, 3}
    master = spark.createDataFrame([("a", "Control"), ("b", "AD")], "projid string, diagnosis string")
    assert sorted(r["projid"] for r in cohort.with_controls(master, master).collect()) == ["a", "a", "b"]
    bare = spark.createDataFrame([(None, 1), ("ST1", 2)], "subtype string, projid int")
    assert [tuple(r) for r in cohort.name_subtypes(bare).collect()] == [("ST1", "Unknown-enriched (Unknown)")]
    assert [r["t"] for r in cohort.survival_inputs(bare).orderBy("projid").collect()] == [0.0, 1.0]
    profiles = spark.createDataFrame([(1, "x", "Ex", 2.0)], "sample_id int, feature_id string, cell_type string, abundance double")
    marks = spark.createDataFrame([("Ex", "x")], "cell_type string, feature_id string")
    assert deconv.marker_purity(profiles, marks).first()["purity"] == pytest.approx(2 / (2 + 0.0001 + 1e-8))


def test_spearman_skips_a_measure_that_is_mostly_missing(spark):
    df = spark.createDataFrame([(float(i), float(i) if i < 5 else None) for i in range(10)], "x double, y double")
    assert stats.spearman(df, "x", "y", 0.5).first()["rho"] is None and stats.spearman(df, "x", "y", 0.6).first()["rho"] == pytest.approx(1)


def test_validation_of_a_time_by_its_measures(spark):
    rows = [(float(i), 30.0 - i, float(i % 3), None if i % 2 else 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "t double, mmse double, braaksc double, cogdx double")
    got = {r["measure"]: r for r in stats.time_validation(df, "t", {"mmse": "mmse", "braaksc": "braaksc", "cogdx": "cogdx"}).collect()}
    assert got["mmse"]["rho"] == pytest.approx(-1) and got["mmse"]["passed"]
    assert 0 < got["braaksc"]["rho"] < 0.30 and not got["braaksc"]["passed"]
    assert got["cogdx"]["rho"] is None and not got["cogdx"]["passed"] and got["cogdx"]["n"] == 6
    assert stats.time_validation(df, "t", {}).count() == 0


def test_patients_in_order_of_their_ids(spark):
    for ids in ([5, 1, 30, 2], ["b12345", "a2", "b12346", "b1234"]):
        df = spark.createDataFrame([(i,) for i in ids], "projid long" if ids[0] == 5 else "projid string")
        assert {r["projid"]: r["t"] for r in cohort.in_order(df).collect()} == {i: float(k) for k, i in enumerate(sorted(ids))}


def test_study_writes_its_tables_and_stops_at_the_first_failure(spark, tmp_path):
    from cohortloom.plans import steps
    from cohortloom.sources import io

    m, c, cells = io.synthetic_matrix(spark, 24, 10).cache(), io.synthetic_clinical(spark, 24).cache(), io.synthetic_cells(spark, 40, 10)
    bulk = m.withColumn("feature_id", F.regexp_replace("feature_id", "PROT", "GENE"))
    folder = str(tmp_path / "study")
    log = {r["step"]: r["status"] for r in steps.study(spark, folder, bulk, c, cells, n_subtypes=2, runs=2, steps=20, least_overlap=0.0).collect()}
    assert log | {"1C": "PASS"} == dict.fromkeys(("1A", "1B", "1C", "1D", "1E", "1F", "2A"), "PASS") and log["1C"] in ("PASS", "WARNING")
    master = spark.read.parquet(f"{folder}/master")
    assert master.count() == 24 and {"dpt", "ct_Ex", "patient_class", "subtype"} <= set(master.columns)
    assert spark.read.text(f"{folder}/report").first()["value"] == "SUBTYPES" and io.networks(spark, f"{folder}/edges") == [("all", "all")]
    assert io.read_edges(spark, f"{folder}/none").count() == 0
    assert [r["present"] for r in io.availability(spark, {"a": folder, "b": f"{folder}/none"}).collect()] == [True, False]
    short = {r["step"]: r["status"] for r in steps.study(spark, str(tmp_path / "two"), bulk, c, skip=("1B", "1A")).collect()}
    assert short["1A"] == short["1B"] == "SKIPPED" and short["1C"] == "FAIL" and short["1D"] == "NOT RUN"


def test_components_are_those_of_the_decomposition(spark, sf):
    from cohortloom.sources import views

    m = views.emb_long(spark, sf)
    scores, shares = matrix.principal_components(m, 3)
    got = {r["sample_id"]: r["scores"] for r in scores.collect()}
    rows = {r["sample_id"]: r["features"] for r in matrix.arrays(m).collect()}
    x = np.array([rows[i] for i in sorted(rows)])
    x -= x.mean(axis=0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:3])
    sign = np.sign(v[np.arange(3), np.abs(v[:3]).argmax(axis=1)])
    assert np.allclose([got[i] for i in sorted(got)], u[:, :3] * s[:3] * sign, atol=1e-6)


def test_betweenness_by_sources_adds_up(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 15, 60), rng.integers(0, 15, 60), rng.integers(1, 5, 60)) if a != b}.items())
    flat = [(a, b, w) for (a, b), w in edges]
    got = {r["node"]: r["betweenness"] for r in network.betweenness(spark.createDataFrame(flat, "a long, b long, w double")).collect()}
    whole = kernels.betweenness(sorted({v for e in flat for v in e[:2]}), flat)
    assert got == pytest.approx(whole)
