"""The steps of a cohort study as chains of operators over DataFrames, and the study that runs and stores them.

Who chains steps without `study` should store a step's tables too: plans of several steps grow long.

A step returns its results by name with a status. `study` runs the steps in turn, writes what each
gives below one folder, updates the master table there, and keeps a log; the first failure ends it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, deconv, factor, forest, lasso, matrix, network, pairs, stats, trajectory
from ..sources import io
from . import models as graph_models


def preprocess(m: DataFrame, clinical: DataFrame, max_missing_pct: float = 50.0, k: int = 5, covariates: tuple[str, ...] = ("age_death", "msex", "pmi")) -> dict:
    """Quality control, imputation, log2, z-scores and adjustment for covariates."""
    kept = matrix.qc_filter(m, max_missing_pct).persist()  # read by every join of the imputation
    full = kept.where("value is not null").unionByName(matrix.knn_impute(kept, k))
    scaled = matrix.zscore(matrix.log2_transform(full))
    return {"status": "PASS", "matrix": matrix.residualise(scaled, clinical.withColumnRenamed("projid", "sample_id"), list(covariates))}


def deconvolve(m: DataFrame, cells: DataFrame | None, markers: DataFrame | None = None) -> dict:
    """Proportions, profiles and purity; without a reference every type has an equal share (SKIPPED)."""
    if cells is None:
        types = ["Ast", "Ex", "In", "Mic", "OPCs", "Oli"]
        shares = m.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, types))).alias("cell_type")).withColumn("proportion", F.lit(1 / len(types)))
        return {"status": "SKIPPED", "proportions": shares, "profiles": deconv.celltype_profiles(m, shares)}
    profile = deconv.reference_profiles(cells)
    shared = m.join(profile.select(F.col("gene_id").alias("feature_id")).distinct(), "feature_id", "left_semi")
    genes = profile.join(shared.select(F.col("feature_id").alias("gene_id")).distinct(), "gene_id", "left_semi")
    reference = matrix.arrays(genes.select(F.col("cell_type").alias("sample_id"), F.col("gene_id").alias("feature_id"), "value")).withColumnRenamed("sample_id", "cell_type")
    shares = deconv.proportions(matrix.arrays(matrix.complete_grid(shared)), reference)
    out = {"status": "PASS", "proportions": shares, "profiles": deconv.celltype_profiles(m, shares)}
    return out | ({"purity": deconv.marker_purity(out["profiles"], markers)} if markers is not None else {})


def classify(clinical: DataFrame) -> dict:
    classes = cohort.classify_patients(clinical)
    return {"status": "PASS", "classes": classes, "counts": classes.groupBy("patient_class").count()}


def pseudotime(m: DataFrame, clinical: DataFrame, k: int = 15) -> dict:
    """A layout in two dimensions and the diffusion pseudotime from the calmest sample nearest to its middle."""
    arrays = matrix.arrays(m).persist()  # packed for the graph and counted twice; made again if an executor is lost
    near = pairs.nearest(arrays, k).persist()
    start, _ = matrix.principal_components(m, min(2, m.select("feature_id").distinct().count()))
    places = trajectory.layout(pairs.fuzzy_weights(near, k), start).persist()
    root = cohort.root_cell(places, clinical.select("projid", "cogdx", "braaksc")).first()["root"]
    times = trajectory.pseudotime(*trajectory.diffusion_map(arrays, k, near=near), F.col("sample_id") == F.lit(root))
    return {"status": "PASS", "pseudotime": times.join(places, "sample_id").withColumnRenamed("sample_id", "projid")}


def validate_time(times: DataFrame, clinical: DataFrame) -> dict:
    """The rank correlations of the pseudotime with the clinical measures, and WARNING unless all four go as expected."""
    columns = {m: c for m, _, _ in stats.EXPECTED if (c := cohort.resolve(clinical, m))}
    found = stats.time_validation(clinical.join(times.select("projid", "dpt"), "projid"), "dpt", columns).persist()  # four rows
    passed = found.where("passed").count()
    return {"status": "PASS" if passed == len(stats.EXPECTED) else "WARNING", "validation": found}


def subtypes(m: DataFrame, master: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), runs: int = 50, steps: int = 1000, k: int | None = None) -> dict:
    """Subtypes of the clinical cases by factorisations agreed upon; k by cophenetic correlation unless given."""
    cases = cohort.subtype_cohort(master).select(F.col("projid").alias("sample_id"))
    x = matrix.arrays(matrix.shift_nonnegative(m.join(cases, "sample_id", "left_semi")))
    blocks, hs, _ = factor.factorised(x, (k,) if k else ks, runs, steps)
    arrays = factor.label_arrays(blocks, hs, m.schema["sample_id"].dataType.simpleString()).persist()  # one row a sample and k; read by both results
    classes = factor.classes(arrays, ["k"])[0].persist()
    fits = factor.agreement(classes, factor.class_shares(factor.few_classes(classes), ["k"]))
    best = k or cohort.select_k(fits).first()["k"]
    named = arrays.where(F.col("k") == best).select(F.col("sample_id").alias("projid"), F.concat(F.lit("ST"), F.col("labels")[0] + 1).alias("subtype"))
    return {"status": "PASS", "subtypes": named, "fits": fits}


def validate(master: DataFrame, group: str = "subtype", measures: tuple[str, ...] = ("mmse", "braaksc", "ceradsc")) -> dict:
    """Rank tests of the measures over the groups, survival by group, the groups' sizes and their names."""
    timed = cohort.survival_inputs(master.where(F.col(group).isNotNull())).withColumn("event", F.col("event").cast("int"))
    held = [(m, c) for m in measures if (c := cohort.resolve(master, m))]
    tests = None
    for m, c in held:
        one = stats.group_test(timed, group, c).select(F.lit(m).alias("measure"), "test", "stat", "p")
        tests = one if tests is None else tests.unionByName(one)
    out = {"status": "PASS", "survival": stats.product_limit(timed, group, "t", "event"), "sizes": timed.groupBy(group).count(), "names": cohort.name_subtypes(master.withColumnRenamed(group, "subtype"))}
    return out | ({"tests": tests} if tests is not None else {})


def report(validation: dict) -> list[str]:
    """The lines of the text report: the groups' names and sizes, then the tests (few rows each)."""
    sizes = {r[0]: r["count"] for r in validation["sizes"].collect()}
    lines = ["SUBTYPES", *(f"  {r['subtype']}: {r['name']} (n={sizes.get(r['subtype'], 0)})" for r in validation["names"].orderBy("subtype").collect())]
    if "tests" in validation:
        lines += ["", "CLINICAL DIFFERENCES", *(f"  {r['measure']}: {r['test']} statistic {r['stat']:.4f}, p = {r['p']:.3e}" for r in validation["tests"].orderBy("measure").collect())]
    return lines


NETWORK = ["subtype", "cell_type"]


def network_profiles(profiles: DataFrame, subtypes: DataFrame, first_type: bool = False, n_features: int | None = None) -> DataFrame:
    """(subtype, cell_type, sample_id, feature_id, value): the profiles of the patients that have a subtype; of the first cell type and the first features only, if asked."""
    own = io.with_sample_id(subtypes.where(F.col("subtype").isNotNull())).select("sample_id", "subtype")
    m = io.with_sample_id(profiles).join(own, "sample_id").select(*NETWORK, "sample_id", "feature_id", F.col("abundance").alias("value"))
    if first_type:
        m = m.join(m.groupBy("subtype").agg(F.min("cell_type").alias("cell_type")), NETWORK, "left_semi").select(m.columns)
    if n_features is not None:
        m = m.join(matrix.first_features(m, n_features).select("feature_id").distinct(), "feature_id", "left_semi").select(m.columns)
    return m


def as_edges(edges: DataFrame, layer: str) -> DataFrame:
    """(by, i, j, w) as stored edges of a layer."""
    return edges.select(*NETWORK, F.col("i").alias("protein_a"), F.col("j").alias("protein_b"), F.col("w").alias("weight"), F.lit(layer).alias("layer"), F.lit(network.LAYER_WEIGHTS[layer]).alias("consensus_weight"))


def coexpression(m: DataFrame, n_features: int, least: float = 0.1, by: list[str] | None = None) -> dict:
    """Edges of the overlap networks, each at its fitted power."""
    corr = network.abs_corr(m, by).persist()  # used by the fit and by the overlap; recomputed if an executor is lost
    fit = network.soft_threshold(corr, n_features, by=by)
    if by:
        tom = network.topological_overlap(corr, fit.select(*by, "chosen").distinct(), by)
    else:
        first = fit.select("chosen").first()
        tom = network.topological_overlap(corr, first["chosen"] if first else 6)
    return {"status": "PASS", "fit": fit, "edges": network.tom_edges(tom, least)}


def sparse_precision(m: DataFrame, fixed: float | None = None) -> dict:
    """Edges of every network's sparse precision matrix by the arm of its size, or at a fixed penalty; of at most 500 features."""
    few = matrix.prefilter_by(m, 500)
    found = lasso.fixed(few, NETWORK, fixed) if fixed else lasso.networks(few, NETWORK)
    return {"status": "PASS", "edges": as_edges(found.withColumnRenamed("weight", "w"), "glasso")}


def directed_importance(m: DataFrame, trees: int = 100) -> dict:
    """The strongest 5 % of every network's importances; networks are few and are grown in turn, each over all its samples at once."""
    few, edges = matrix.prefilter_by(m, 500).persist(), None
    for r in few.select(*NETWORK).distinct().orderBy(*NETWORK).collect():
        own = few.where((F.col("subtype") == r["subtype"]) & (F.col("cell_type") == r["cell_type"]))
        one = network.top_share(forest.importances(own.select("sample_id", "feature_id", "value"), trees), "w")
        one = one.select(F.lit(r["subtype"]).alias("subtype"), F.lit(r["cell_type"]).alias("cell_type"), "i", "j", "w")
        edges = one if edges is None else edges.unionByName(one)
    kind = m.schema["feature_id"].dataType.simpleString()
    return {"status": "PASS", "edges": as_edges(edges if edges is not None else m.sparkSession.createDataFrame([], f"subtype string, cell_type string, i {kind}, j {kind}, w double"), "causal")}


def consensus(edges: DataFrame, known: DataFrame | None = None) -> dict:
    """The consensus of the three layers of every network, and each node's degree."""
    layer = lambda n: edges.where(F.col("layer") == n).select(*NETWORK, F.col("protein_a").alias("i"), F.col("protein_b").alias("j"), F.col("weight").alias("w"))
    known = known if known is not None else edges.sparkSession.createDataFrame([], "i string, j string")
    merged = network.consensus_edges(layer("wgcna"), layer("glasso"), layer("causal"), known, NETWORK)
    ends = merged.select(*NETWORK, F.col("i").alias("node")).unionAll(merged.select(*NETWORK, F.col("j").alias("node")))
    return {"status": "PASS", "edges": merged, "nodes": ends.groupBy(*NETWORK, "node").agg(F.count("*").alias("degree"))}


def run_all(steps: list[tuple[str, Callable[[dict], dict]]]) -> dict:
    """Runs named steps in turn, each given the results so far; the first that raises is marked FAIL and ends the run."""
    done: dict = {}
    for name, step in steps:
        try:
            done[name] = step(done)
        except Exception as e:  # the study reports what broke, and stops
            done[name] = {"status": "FAIL", "error": str(e)}
            break
    return done


def study(spark: SparkSession, folder: str, m: DataFrame, clinical: DataFrame, cells: DataFrame | None = None, markers: DataFrame | None = None, skip: tuple[str, ...] = (), n_subtypes: int | None = None, runs: int = 50, steps: int = 1000, least_overlap: float = 0.1, networks: bool = False, test: bool = False, known: DataFrame | None = None, models: bool = False) -> DataFrame:
    """Runs the steps 1A to 1F and the co-expression of 2A, writes their tables below the folder, and returns the log (step, status, seconds, error).

    With `networks`, 2A to 2D run for every subtype and cell type: co-expression, sparse precision, directed importance and
    their consensus with `known` pairs (i, j); `test` takes the first cell type and ten features, ten trees, an overlap from 0.01 and a penalty of 0.5. With `models` the networks are made and then the graph models
    of each: 3A bundles of graphs, 3E thirty seeds of 50 epochs with their stability, 3F baselines (in a `test`: of the first network, two seeds of three epochs). The status of 1C is WARNING
    if the pseudotime does not go with the clinical measures. `skip` names steps that are passed over (1B without deconvolution has equal shares); a step that needs one that was skipped fails.
    """
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    save = lambda df, name: io.write_table(df, f"{folder}/{name}")

    def keep(out: dict, **names: str) -> dict:
        for key, name in names.items():
            if key in out:
                save(out[key], name)
        return out

    def load(_):
        out = keep(preprocess(m, clinical), matrix="matrix")
        save(clinical, "master")
        return out

    def profiles(_):
        bulk = m.where("value is not null")
        out = keep(deconvolve(bulk, cells, markers), proportions="proportions", profiles="profiles", purity="validation")
        shares = read("proportions").groupBy(F.col("sample_id").alias("projid")).pivot("cell_type").agg(F.first("proportion"))
        wide = shares.select("projid", *[F.col(f"`{c}`").alias(f"ct_{c}") for c in shares.columns if c != "projid"])
        io.update_table(spark, f"{folder}/master", lambda d: d.join(wide, "projid", "left"))
        return out

    def time_of(_):
        out = keep(pseudotime(read("matrix"), clinical), pseudotime="pseudotime")
        io.update_table(spark, f"{folder}/master", lambda d: d.join(read("pseudotime"), "projid", "left"))
        return keep(validate_time(read("pseudotime"), clinical), validation="pseudotime_validation") | {"pseudotime": out["pseudotime"]}

    def classes(_):
        out = keep(classify(read("master")), counts="class_counts")
        save(out["classes"].select("projid", "patient_class"), "classes")
        io.update_table(spark, f"{folder}/master", lambda d: cohort.update_column(d, read("classes"), "projid", "patient_class"))
        return out

    def clusters(_):
        out = keep(subtypes(read("matrix"), read("master"), k=n_subtypes, runs=runs, steps=steps), subtypes="subtypes", fits="subtype_fits")
        io.update_table(spark, f"{folder}/master", lambda d: cohort.update_column(d, read("subtypes"), "projid", "subtype"))
        return out

    def check(_):
        out = keep(validate(read("master")), tests="tests", survival="survival", sizes="subtype_sizes", names="subtype_names")
        io.write_report(spark, report(out), f"{folder}/report")
        return out

    def overlap(_):
        x = read("matrix")
        out = coexpression(x, x.select("feature_id").distinct().count(), least_overlap)
        io.write_edges(out["edges"].withColumns({"subtype": F.lit("all"), "cell_type": F.lit("all")}), f"{folder}/edges")
        return out

    def own_networks():
        return network_profiles(read("profiles"), read("subtypes"), test, 10 if test else None)

    def overlaps(_):
        x = own_networks().persist()
        out = coexpression(x, x.select("feature_id").distinct().count(), 0.01 if test else least_overlap, NETWORK)
        save(out["edges"], "wgcna")
        return out

    def precision(_):
        out = sparse_precision(own_networks(), 0.5 if test else None)
        save(out["edges"], "glasso")
        return out

    def importance(_):
        out = directed_importance(own_networks(), 10 if test else forest.TREES)
        save(out["edges"], "causal")
        return out

    def agreed(_):
        layers = read("wgcna").unionByName(read("glasso")).unionByName(read("causal"))
        io.write_edges(layers, f"{folder}/edges")
        return keep(consensus(layers, known), edges="consensus", nodes="consensus_nodes")

    def bundled(_):
        nodes = graph_models.bundle_nodes(read("consensus"))
        if nodes is None:
            return {"status": "SKIPPED"}
        save(nodes, "bundle_nodes")
        bundle = graph_models.bundles(read("bundle_nodes"), read("profiles"), read("proportions"), read("master"))
        io.write_table(bundle, f"{folder}/bundles", tuple(NETWORK))
        return {"status": "PASS"}

    def each_network():
        return graph_models.each(read("bundle_nodes"), read("consensus"), read("bundles"), test)

    def steady(_):
        if not io.exists(spark, f"{folder}/bundles"):
            return {"status": "SKIPPED"}

        def stored(df, name):
            save(df, f"step3/{name}")
            return read(f"step3/{name}")

        few = {"seeds": 2, "epochs": 3, "top": 5} if test else {}
        return keep(graph_models.stability(each_network(), stored, **few), evaluation="evaluation", scores="stability_scores", summary="stability_summary")

    def benchmarked(_):
        if not io.exists(spark, f"{folder}/bundles"):
            return {"status": "SKIPPED"}
        return keep(graph_models.baselines(each_network(), *((10, 5) if test else ())), benchmarks="benchmarking_summary")

    networks = networks or models
    listed = [("1A", load), ("1B", profiles), ("1C", time_of), ("1D", classes), ("1E", clusters), ("1F", check), *([("2A", overlaps), ("2B", precision), ("2C", importance), ("2D", agreed)] if networks else [("2A", overlap)]), *([("3A", bundled), ("3E", steady), ("3F", benchmarked)] if models else [])]
    took: dict[str, float] = {}

    def timed(name, step):
        def run(done):
            began = time.time()
            try:
                return step(done)
            finally:
                took[name] = time.time() - began

        return run

    done = run_all([(n, timed(n, s)) for n, s in listed if n not in skip])
    rows = [(n, done[n]["status"] if n in done else "SKIPPED" if n in skip else "NOT RUN", float(took.get(n, 0)), done.get(n, {}).get("error")) for n, _ in listed]
    log = spark.createDataFrame(rows, "step string, status string, seconds double, error string")
    save(log, "log")
    return log
