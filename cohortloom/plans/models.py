"""Graph models of a study: bundles of graphs a network (3A), stability over seeds (3E) and baselines on means (3F)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gat
from ..operators import graphnet, network, perceptron, stats
from ..sources import io

NETWORK = ["subtype", "cell_type"]
N_FEATURES = 7

# fixed values: genes of known risk
RISK_GENES = ["APOE", "BIN1", "TREM2", "CLU", "CR1", "PICALM", "ABCA7", "MS4A6A", "CD33", "SORL1"]


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _named(df: DataFrame, subtype: str, cell_type: str) -> DataFrame:
    return df.withColumns({"subtype": F.lit(subtype), "cell_type": F.lit(cell_type)})


def network_names(edges: DataFrame) -> list[tuple[str, str]]:
    """The networks of a study are few: subtypes × cell types."""
    return [tuple(r) for r in edges.select(*NETWORK).distinct().orderBy(*NETWORK).collect()]


def of(df: DataFrame, subtype: str, cell_type: str) -> DataFrame:
    return df.where((F.col("subtype") == subtype) & (F.col("cell_type") == cell_type)).drop(*NETWORK)


def bundle_nodes(edges: DataFrame, risk: list[str] | None = None) -> DataFrame | None:
    """(subtype, cell_type, place, node, degree, betweenness, risk_gene) of edges(subtype, cell_type, i, j, total_weight), places from 0 in the nodes' order; None without edges."""
    parts = []
    for names in network_names(edges):
        own = of(edges, *names)
        between = network.betweenness(own.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("total_weight").alias("w")))
        parts.append(_named(network.degree(own).join(between, "node", "left"), *names))
    if not parts:
        return None
    place = (F.row_number().over(Window.partitionBy(*NETWORK).orderBy("node")) - 1).alias("place")  # the nodes of one network
    flag = F.col("node").cast("string").isin(RISK_GENES if risk is None else risk).cast("double").alias("risk_gene")
    return _union(parts).select(*NETWORK, place, "node", F.col("degree").cast("double").alias("degree"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), flag)


def bundles(nodes: DataFrame, profiles: DataFrame, proportions: DataFrame, master: DataFrame) -> DataFrame:
    """(subtype, cell_type, sample_id, x, y, t): for every network the patients of its subtype (y 1) and the healthy controls (y 0) that have abundances.

    x holds seven features of node after node: abundance (0 if absent), pseudotime, the cell type's proportion, sex,
    degree, betweenness, risk gene. t is the pseudotime, 0 where unknown. A repeated abundance of a patient, cell type and feature is an error.
    """
    time = F.coalesce(F.col("dpt").cast("double"), F.lit(0.0)) if "dpt" in master.columns else F.lit(0.0)
    people = master.select(F.col("projid").alias("sample_id"), F.col("subtype").alias("_own"), "patient_class", time.alias("t"), F.when(F.col("msex") == 1, 1.0).otherwise(0.0).alias("sex"))
    subtypes = [r[0] for r in nodes.select("subtype").distinct().orderBy("subtype").collect()]
    cases = people.where(F.col("_own").isin(subtypes)).select("sample_id", F.col("_own").alias("subtype"), F.lit(1.0).alias("y"), "t", "sex")
    controls = people.where((F.col("patient_class") == "Healthy Control") & F.col("_own").isNull()).select("sample_id", F.explode(F.array(*map(F.lit, subtypes))).alias("subtype"), F.lit(0.0).alias("y"), "t", "sex")
    wanted = nodes.select("cell_type", F.col("node").alias("feature_id")).distinct()
    held = io.with_sample_id(profiles).join(wanted, ["cell_type", "feature_id"], "left_semi").groupBy("sample_id", "cell_type")
    abundance = held.agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "abundance"))).alias("held"))  # at most the nodes of the networks
    listed = nodes.groupBy(*NETWORK).agg(F.sort_array(F.collect_list(F.struct("place", "node", "degree", "betweenness", "risk_gene"))).alias("nodes"))
    share = proportions.select("sample_id", "cell_type", F.col("proportion").cast("double").alias("share"))
    rows = cases.unionByName(controls).join(abundance, "sample_id").join(listed, NETWORK).join(share, ["sample_id", "cell_type"], "left")
    seven = lambda n: F.array(F.coalesce(F.try_element_at("held", n["node"]).cast("double"), F.lit(0.0)), F.col("t"), F.coalesce("share", F.lit(0.0)), F.col("sex"), n["degree"], n["betweenness"], n["risk_gene"])
    return rows.select(*NETWORK, "sample_id", F.flatten(F.transform("nodes", seven)).alias("x"), "y", "t")


class One(NamedTuple):
    """A network's names, nodes in order, edges by place, and graphs."""

    names: tuple[str, str]
    nodes: list
    edges: list[tuple[int, int]]
    graphs: DataFrame


def each(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, first: bool = False) -> Iterator[One]:
    """The networks in turn (only the first, if asked); nodes and edges, bounded by network.MAX_EDGES, come to the driver."""
    names = network_names(nodes)
    for n in names[:1] if first else names:
        listed = [r["node"] for r in of(nodes, *n).orderBy("place").collect()]
        rows = of(edges, *n).select("i", "j").limit(network.MAX_EDGES + 1).collect()
        if len(rows) > network.MAX_EDGES:
            raise ValueError(f"a network of over {network.MAX_EDGES} edges")
        at = {v: k for k, v in enumerate(listed)}
        yield One(n, listed, [(at[r["i"]], at[r["j"]]) for r in rows], of(graphs, *n))


def stability(networks: Iterator[One], store, seeds: int = 30, epochs: int = 50, top: int = 20, steps: int = 50) -> dict:
    """Trains every network's seeds; `store(table, name)` writes one and gives it back, so that nothing is trained twice.

    Gives predictions, evaluation (seed, n, loss, auroc), scores (node, frequency, is_stable) and summary (mean_jaccard, mean_auroc, mean_loss, n_stable), each by network.
    """
    out: dict[str, list[DataFrame]] = {"predictions": [], "evaluation": [], "scores": [], "summary": []}
    for k, one in enumerate(networks):
        spark, graph = one.graphs.sparkSession, gat.Graph(len(one.nodes), one.edges)
        blocks = graphnet.pack(one.graphs, len(one.nodes), N_FEATURES, range(seeds))
        models = graphnet.train(spark, blocks, graph, N_FEATURES, range(seeds), epochs)
        kind = one.graphs.schema["sample_id"].dataType.simpleString()
        predicted = store(graphnet.predictions(spark, blocks, models, graph, kind), f"predictions/{k}")
        place = {i: v for i, v in enumerate(one.nodes)}
        found = graphnet.attributions(spark, blocks, models, graph, len(one.nodes), steps)
        blocks.unpersist()
        named = spark.createDataFrame([(i, str(v)) for i, v in place.items()], "node int, name string")
        importance = found.join(named, "node").select("seed", F.col("name").alias("node"), "importance")
        scores, sets = graphnet.stable_nodes(importance, seeds, top)
        evaluated = graphnet.evaluate(predicted)
        for name, table in (("predictions", predicted), ("evaluation", evaluated), ("scores", scores), ("summary", graphnet.stability_summary(scores, sets, evaluated))):
            out[name].append(_named(table, *one.names))
    return {"status": "PASS"} | {n: u for n, parts in out.items() if (u := _union(parts)) is not None}


def tabular(graphs: DataFrame, n_nodes: int, n_features: int = N_FEATURES, seed: int = 42) -> DataFrame:
    """(sample_id, label, time, x, features, train): the mean of each feature over the nodes; rows with a NULL label or time are left out."""
    every = F.sequence(F.lit(0), F.lit(n_nodes - 1))
    mean = lambda k: F.aggregate(F.transform(every, lambda i: F.get("x", i * n_features + k)), F.lit(0.0), lambda a, b: a + b) / n_nodes
    rows = graphs.where(F.col("y").isNotNull() & F.col("t").isNotNull())
    t = rows.select("sample_id", F.col("y").cast("double").alias("label"), F.col("t").cast("double").alias("time"), F.array(*[mean(k) for k in range(n_features)]).alias("x"))
    return t.select("*", array_to_vector("x").alias("features"), graphnet.in_train(F.col("sample_id"), seed).alias("train"))


def baseline(t: DataFrame, steps: int = 200, trees: int = 100) -> DataFrame:
    """(model, classification_auroc, regression_mse) of multilayer and boosted models on the held-out rows of a tabular(); no rows if one part is empty."""
    spark = t.sparkSession
    t = t.persist()
    fit, held = t.where("train"), t.where("not train")
    if not fit.take(1) or not held.take(1):
        return spark.createDataFrame([], "model string, classification_auroc double, regression_mse double")
    width = len(fit.first()["x"])
    classes = {"mlp": MultilayerPerceptronClassifier(layers=[width, *perceptron.HIDDEN, 2], seed=42, maxIter=steps), "gbt": GBTClassifier(maxDepth=3, maxIter=trees, seed=42)}
    times = {
        "mlp": perceptron.predict(held, perceptron.train(fit, "x", "time", steps=steps), "x"),
        "gbt": GBTRegressor(labelCol="time", maxDepth=3, maxIter=trees, seed=42).fit(fit).transform(held),
    }
    out = []
    for name, model in classes.items():
        scored = model.fit(fit).transform(held).select("label", vector_to_array("probability")[1].alias("score"))
        area = stats.auroc(scored, "label", "score").select(F.lit(name).alias("model"), F.col("auroc").alias("classification_auroc"))
        out.append(area.crossJoin(perceptron.mean_squared_error(times[name], "prediction", "time").select(F.col("mse").alias("regression_mse"))))  # one row each
    return _union(out)


def baselines(networks: Iterator[One], steps: int = 200, trees: int = 100) -> dict:
    """The baselines of every network."""
    found = _union([_named(baseline(tabular(one.graphs, len(one.nodes)), steps, trees), *one.names) for one in networks])
    return {"status": "PASS"} | ({} if found is None else {"benchmarks": found})
