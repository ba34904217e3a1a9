import numpy as np
import pytest

from cohortloom.functions import gat
from cohortloom.operators import cohort
from cohortloom.sources import io


def test_wide_csv_round_trip(spark, tmp_path):
    f = tmp_path / "wide.csv"
    f.write_text("patient_id,P.1,P2\na,1.5,\nb,NaN,2\n")
    got = {(r["sample_id"], r["feature_id"]): r["value"] for r in io.read_wide_csv(spark, str(f)).collect()}
    assert got == {("a", "P.1"): 1.5, ("a", "P2"): None, ("b", "P.1"): None, ("b", "P2"): 2.0}
    tall = tmp_path / "tall.csv"
    tall.write_text("id,s1,s2\n" + "".join(f"F{i},{i},1\n" for i in range(1001)))
    assert {r[0] for r in io.read_wide_csv(spark, str(tall)).select("sample_id").distinct().collect()} == {"s1", "s2"}


def test_repeated_ids_are_an_error(spark):
    m = spark.createDataFrame([("a", "x", 1.0)], "sample_id string, feature_id string, value double")
    c = spark.createDataFrame([("a", 1), ("b", 2)], "projid string, msex int")
    assert io.join_samples(m, c).count() == 1
    with pytest.raises(Exception, match="repeated id"):
        io.join_samples(m, c.unionAll(c)).collect()


def test_synthetic_cohort(spark):
    m, c = io.synthetic_matrix(spark, 50, 40), io.synthetic_clinical(spark, 400)
    assert m.count() == 2000 and 0.1 < m.where("value is null").count() / 2000 < 0.2
    classes = {r["patient_class"] for r in cohort.classify_patients(c).select("patient_class").distinct().collect()}
    assert classes == {"Clinical AD", "AsymAD", "Healthy Control"}
    assert io.synthetic_cells(spark, 20, 5).where("value < 0").count() == 0


def test_edges_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("p", "q", 0.5, 0.3, "ST1", "Ex", "wgcna")], io.EDGE_SCHEMA)
    io.write_edges(e, str(tmp_path / "edges"))
    back = io.read_edges(spark, str(tmp_path / "edges")).where("layer = 'wgcna'").collect()
    assert [r.asDict() for r in back] == [r.asDict() for r in e.collect()]


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    g = gat.Graph(5, [(0, 1), (1, 2), (3, 2), (4, 0)])
    x, y, t, p = rng.normal(size=(3, 5, 7)), np.array([0.0, 1, 1]), rng.random(3), gat.start(1)
    logit, score, kept = gat.forward(p, x, g)
    _, dc, ds = gat.loss(logit, score, y, t)
    grads, dx = gat.backward(p, x, g, kept, dc, ds)

    def value():
        a, b, _ = gat.forward(p, x, g)
        return gat.loss(a, b, y, t)[0]

    for array, grad in [(p[k], grads[k]) for k in p] + [(x, dx)]:
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-5
            up = value()
            array[at] = old - 1e-5
            down = value()
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attributions_add_up_and_training_learns():
    rng = np.random.default_rng(2)
    g = gat.Graph(4, [(0, 1), (2, 3)])
    x = rng.normal(size=(60, 4, 7))
    y = (x[:, :, 0].mean(axis=1) > 0).astype(float)
    p = gat.train(x, y, y, g, seed=0, epochs=15)
    logit, _, _ = gat.forward(p, x, g)
    assert ((logit > 0) == (y > 0)).mean() > 0.9
    base, _, _ = gat.forward(p, x * 0, g)
    assert np.allclose(gat.integrated_gradients(p, x, g, 200).sum(axis=(1, 2)), logit - base, atol=0.05)


def test_asked_for_gradients_are_those_of_the_whole_way_back():
    rng = np.random.default_rng(9)
    g = gat.Graph(6, [(0, 1), (1, 2), (5, 2), (4, 0)])
    x, p, d = rng.normal(size=(4, 6, 7)), gat.start(2), rng.normal(size=4)
    kept = gat.forward(p, x, g)[2]
    grads, dx = gat.backward(p, x, g, kept, d, d)
    none, only_dx = gat.backward(p, x, g, kept, d, d, params=False)
    only_grads, no_dx = gat.backward(p, x, g, kept, d, d, inputs=False)
    assert not none and no_dx is None and np.array_equal(dx, only_dx)
    assert grads.keys() == only_grads.keys() == p.keys() and all(np.array_equal(grads[k], only_grads[k]) and grads[k].shape == p[k].shape for k in p)
