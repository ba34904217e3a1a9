"""The networks of a study, its command line, and the scans and graph tables beside it."""

import json

import pytest

from cohortloom import __main__ as command
from cohortloom.plans import steps
from cohortloom.sources import io


def test_profiles_of_the_networks(spark):
    rows = [(p, f, c, float(p + k)) for p in range(4) for k, f in enumerate("abc") for c in ("Ex", "Ast")]
    profiles = spark.createDataFrame(rows, "patient_id int, feature_id string, cell_type string, abundance double")
    subtypes = spark.createDataFrame([(0, "ST1"), (1, "ST1"), (2, "ST2"), (3, None)], "projid int, subtype string")
    whole = steps.network_profiles(profiles, subtypes)
    assert whole.columns == ["subtype", "cell_type", "sample_id", "feature_id", "value"] and whole.count() == 18
    few = steps.network_profiles(profiles, subtypes, True, 2).collect()
    assert {r["cell_type"] for r in few} == {"Ast"} and {r["feature_id"] for r in few} == {"a", "b"} and len(few) == 6
    with pytest.raises(ValueError):
        io.with_sample_id(profiles.select("feature_id"))


def test_consensus_keeps_networks_apart(spark):
    rows = [("ST1", "Ex", "a", "b", 0.5, "wgcna"), ("ST1", "Ex", "b", "a", 0.2, "glasso"), ("ST1", "Ex", "a", "b", 0.9, "causal"), ("ST2", "Ex", "a", "b", 0.7, "causal")]
    edges = spark.createDataFrame(rows, "subtype string, cell_type string, protein_a string, protein_b string, weight double, layer string")
    known = spark.createDataFrame([("a", "b")], "i string, j string")
    out = steps.consensus(edges, known)
    got = {(r["subtype"], r["i"], r["j"]): (r["n_methods"], round(r["total_weight"], 2), r["confidence_tier"]) for r in out["edges"].collect()}
    assert got == {("ST1", "a", "b"): (3, 1.15, "Highest"), ("ST1", "b", "a"): (2, 0.65, "Moderate"), ("ST2", "a", "b"): (1, 0.5, "Low")}
    assert {(r["subtype"], r["node"]): r["degree"] for r in out["nodes"].collect()} == {("ST1", "a"): 2, ("ST1", "b"): 2, ("ST2", "a"): 1, ("ST2", "b"): 1}


def test_json_and_graph_tables(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"k": 2, "names": ["x", "y"]}, indent=1))
    assert io.read_json(spark, str(tmp_path / "one.json")).first().asDict() == {"k": 2, "names": ["x", "y"]}
    nodes, edges = spark.createDataFrame([("a", 1)], "node string, degree int"), spark.createDataFrame([("a", "b", 0.5)], "i string, j string, w double")
    for _ in range(2):  # the second replaces the first
        io.write_graph(nodes, edges, str(tmp_path / "graph"))
    got = io.read_graph(spark, str(tmp_path / "graph"))
    assert [tuple(r) for r in got[0].collect()] == [("a", 1)] and [tuple(r) for r in got[1].collect()] == [("a", "b", 0.5)]
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["edges", "nodes"]


def test_study_with_networks_from_the_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path / "out")
    assert command.main(["--test", "--models", "--n-subtypes", "2", "--results-dir", folder], spark) == 0
    said = capsys.readouterr().out
    assert [line.split()[0] for line in said.splitlines()] == ["1A", "1B", "1C", "1D", "1E", "1F", "2A", "2B", "2C", "2D", "3A", "3E", "3F"]
    checked = {r["measure"]: r for r in spark.read.parquet(f"{folder}/pseudotime_validation").collect()}
    assert set(checked) == {"mmse", "braaksc", "ceradsc", "cogdx"}
    assert ("WARNING" in said) == (not all(r["passed"] for r in checked.values()))
    edges = io.read_edges(spark, f"{folder}/edges")
    assert {r["layer"] for r in edges.select("layer").distinct().collect()} <= {"wgcna", "glasso", "causal"} and edges.count() > 0
    assert spark.read.parquet(f"{folder}/consensus").count() >= edges.count()
    graphs, nodes = spark.read.parquet(f"{folder}/bundles"), spark.read.parquet(f"{folder}/bundle_nodes")
    sizes = {(r["subtype"], r["cell_type"]): r["count"] for r in nodes.groupBy("subtype", "cell_type").count().collect()}
    assert {r["y"] for r in graphs.collect()} == {0.0, 1.0} and all(len(r["x"]) == 7 * sizes[r["subtype"], r["cell_type"]] for r in graphs.collect())
    summary = spark.read.parquet(f"{folder}/stability_summary").collect()
    assert len(summary) == 1 and 0 <= summary[0]["mean_jaccard"] <= 1 and 0 <= summary[0]["mean_auroc"] <= 1
    assert spark.read.parquet(f"{folder}/stability_scores").agg({"frequency": "max"}).first()[0] <= 2
    assert {r["model"] for r in spark.read.parquet(f"{folder}/benchmarking_summary").collect()} == {"mlp", "gbt"}
