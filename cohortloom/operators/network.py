"""Protein networks: correlation, soft threshold, topological overlap, edge rules and the consensus of layers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from . import gram

BETAS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14)
LAYER_WEIGHTS = {"wgcna": 0.30, "glasso": 0.35, "causal": 0.35}
KNOWN_BONUS = 0.15


def abs_corr(m: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, r) for i < j: |Pearson| over the samples that have both; NULL against a constant feature. Sums of products by feature blocks."""
    return gram.correlations(m, by=by).withColumn("r", F.abs("r"))


def both_ways(edges: DataFrame, w: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return edges.select(*by, "i", "j", w).unionByName(edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), w))


def soft_threshold(corr: DataFrame, n_features: int, betas: tuple = BETAS, least_r2: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """(by, beta, bins, r2, chosen): scale-free fit of each power; chosen is the first that reaches least_r2, else 6."""
    by = by or []
    spark = corr.sparkSession
    powers = F.broadcast(spark.createDataFrame([(b,) for b in betas], "beta int"))
    k = both_ways(corr.where("r is not null"), "r", by).crossJoin(powers).groupBy(*by, "beta", "i").agg(F.sum(F.pow("r", F.col("beta"))).alias("k"))
    bins = max(3, min(10, n_features // 5))
    bounds = k.groupBy(*by, "beta").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = k.join(F.broadcast(bounds), [*by, "beta"]).withColumn("w", width).withColumn("bin", F.least(F.floor((F.col("k") - F.col("lo")) / F.nullif("w", F.lit(0.0))), F.lit(bins - 1)))
    dense = binned.groupBy(*by, "beta", "bin").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("lo").alias("lo"))
    point = dense.select(*by, "beta", (F.col("lo") + (F.col("bin") + 0.5) * F.col("w")).alias("mid"), (F.col("m") / F.nullif(F.col("n") * F.col("w"), F.lit(0.0))).alias("p")).where("mid > 0 and p > 0")
    x, y = F.log10("mid"), F.log10("p")
    fit = point.select(*by, "beta", x.alias("x"), y.alias("y")).groupBy(*by, "beta").agg(F.count("*").alias("bins"), F.pow(F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)), F.lit(2)).alias("r2"))
    fit = fit.withColumn("r2", F.when(F.col("bins") >= 3, F.col("r2")))
    chosen = F.coalesce(F.min(F.when(F.col("r2") >= least_r2, F.col("beta"))), F.lit(6)).alias("chosen")
    return fit.join(fit.groupBy(*by).agg(chosen), by) if by else fit.crossJoin(F.broadcast(fit.agg(chosen)))


def topological_overlap(corr: DataFrame, beta: int | DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, tom) for i < j, on |r|^beta with the unit diagonal kept in paths and degrees. beta is a number, or (by, chosen) for each group."""
    by = by or []
    known = corr.where("r is not null")
    powered = known.withColumn("_beta", F.lit(float(beta))) if isinstance(beta, int) else known.join(beta.select(*by, F.col("chosen").cast("double").alias("_beta")).distinct(), by)
    a = powered.select(*by, "i", "j", F.pow("r", F.col("_beta")).alias("a"))
    full = both_ways(a, "a", by)
    k = full.groupBy(*by, "i").agg((F.sum("a") + 1).alias("k"))
    paths = gram.squared(full.select(*by, "i", "j", F.col("a").alias("v")), by=by).withColumnRenamed("v", "l")
    ki, kj = k.select(*by, "i", F.col("k").alias("ki")), k.select(*by, F.col("i").alias("j"), F.col("k").alias("kj"))
    joined = a.join(paths, [*by, "i", "j"], "left").join(ki, [*by, "i"]).join(kj, [*by, "j"])
    # the diagonal adds 2a to the paths
    tom = (F.coalesce("l", F.lit(0.0)) + 3 * F.col("a")) / (F.least("ki", "kj") + 1 - F.col("a"))
    return joined.select(*by, "i", "j", tom.alias("tom"))


def tom_edges(tom: DataFrame, least: float = 0.1) -> DataFrame:
    """Edges above the bound; protein_A is the later feature, protein_B the earlier."""
    by = [c for c in tom.columns if c not in ("i", "j", "tom")]
    return tom.where(F.col("tom") > least).select(*by, F.col("j").alias("protein_a"), F.col("i").alias("protein_b"), F.col("tom").alias("weight"), F.lit("wgcna").alias("layer"), F.lit(LAYER_WEIGHTS["wgcna"]).alias("consensus_weight"))


def top_edges(edges: DataFrame, w: str, n: int) -> DataFrame:
    return edges.orderBy(F.desc(w), "i", "j").limit(n)


def cut_at(df: DataFrame, col: str, n: int, bins: int = 1024) -> tuple[float, int] | None:
    """(value, above): the n-th greatest value of a column and how many rows are above it; None if there are fewer rows or n is 0.

    A histogram of the values, then of those in the bin that holds the n-th, until that bin holds one value: each a partial aggregate of `bins` rows.
    """
    first = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if n < 1 or first["n"] < n:
        return None
    lo, hi, above = first["lo"], first["hi"], 0
    while lo < hi:
        # bins are monotone in the value, so a bin's rows are those between its own least and greatest
        at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)) if (hi - lo) / bins > 0 else F.when(F.col(col) < hi, 0).otherwise(1)
        found = df.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] >= n:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo, above


def top_share(edges: DataFrame, w: str, share: float = 0.05, least: float = 1e-4) -> DataFrame:
    """The strongest floor(share * n) of the edges above `least`; none if that is 0. Ties at the cut go by (i, j).

    The cut is found by histograms; only the edges of its very weight are ranked, by the first end (one row a node on the driver) and then, for one node, by the other.
    """
    kept = edges.where(F.col(w) > least).persist()  # read by every histogram; computed again if an executor is lost
    n = int(kept.count() * share)
    cut = cut_at(kept, w, n)
    if cut is None:
        return kept.limit(0)
    value, above = cut
    need, ties = n - above, kept.where(F.col(w) == value)
    last = None
    for r in sorted(ties.groupBy("i").agg(F.count("*").alias("n")).collect(), key=lambda r: r["i"]):
        if need <= r["n"]:
            last = r["i"]
            break
        need -= r["n"]
    rest = ties.where(F.col("i") == last).orderBy("j").limit(need)
    return kept.where(F.col(w) > value).unionByName(ties.where(F.col("i") < last)).unionByName(rest)


def confidence_tier(methods: Column, bonus: Column) -> Column:
    return F.when((methods >= 3) & (bonus > 0), "Highest").when(methods >= 3, "High").when(methods == 2, "Moderate").otherwise("Low")


def consensus_edges(wgcna: DataFrame, glasso: DataFrame, causal: DataFrame, known: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Directed consensus of three layers (by, i, j, w): undirected ones count both ways, the greatest weight of each layer stays.

    `{layer}_w` is the layer's fixed weight where it has the edge and 0 elsewhere, `{layer}_raw` the edge's own weight;
    the total adds the fixed weights and a bonus for known pairs (i, j).
    """
    by = by or []
    layers = [both_ways(wgcna, "w", by).withColumn("layer", F.lit("wgcna")), both_ways(glasso, "w", by).withColumn("layer", F.lit("glasso")), causal.select(*by, "i", "j", "w").withColumn("layer", F.lit("causal"))]
    stacked = layers[0].unionByName(layers[1]).unionByName(layers[2])
    per = stacked.groupBy(*by, "i", "j").agg(*[F.coalesce(F.max(F.when(F.col("layer") == n, F.col("w"))), F.lit(0.0)).alias(f"{n}_raw") for n in LAYER_WEIGHTS])
    bonus = known.select("i", "j", F.lit(KNOWN_BONUS).alias("bonus")).distinct()
    merged = per.join(bonus, ["i", "j"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0))).select(*by, "i", "j", *[f"{n}_raw" for n in LAYER_WEIGHTS], "bonus")
    merged = merged.withColumns({f"{n}_w": F.when(F.col(f"{n}_raw") > 0, w).otherwise(0.0) for n, w in LAYER_WEIGHTS.items()})
    methods = sum(((F.col(f"{n}_w") > 0).cast("int") for n in LAYER_WEIGHTS), F.lit(0))
    total = sum((F.col(f"{n}_w") for n in LAYER_WEIGHTS), F.lit(0.0)) + F.col("bonus")
    return merged.withColumn("n_methods", methods).withColumn("total_weight", total).withColumn("confidence_tier", confidence_tier(F.col("n_methods"), F.col("bonus")))


def degree(edges: DataFrame) -> DataFrame:
    """In and out degree together."""
    ends = edges.select(F.col("i").alias("node")).unionAll(edges.select(F.col("j").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


#: Edges that a network may have to be sent along with the tasks (some 24 bytes each).
MAX_EDGES = 2_000_000


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness) of a directed network edges(a, b, w) with weights as distances.

    Paths are searched from each node apart, nodes dealt over the tasks; the network goes along, so it must have at
    most MAX_EDGES edges (checked).
    """
    spark = edges.sparkSession
    rows = edges.select("a", "b", "w").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"a network of over {MAX_EDGES} edges")
    held = spark.sparkContext.broadcast(sorted((r["a"], r["b"], float(r["w"])) for r in rows))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()

    def run(parts):
        every = sorted({v for e in held.value for v in e[:2]})
        for p in parts:
            score = kernels.betweenness(every, held.value, p["node"].tolist())
            yield pd.DataFrame({"node": list(score), "part": list(score.values())})

    kind = edges.schema["a"].dataType.simpleString()
    dealt = nodes.repartition("node").mapInPandas(run, f"node {kind}, part double")
    return dealt.groupBy("node").agg(F.sum("part").alias("betweenness"))


def node_features(abundance: DataFrame, clinical: DataFrame, proportions: DataFrame, nodes: DataFrame, genes: list) -> DataFrame:
    """The seven features of each (patient, node): abundance, pseudotime, proportion, sex, degree, betweenness, risk-gene flag.

    nodes(node, degree, betweenness) is the network's vertex list; cells without abundance are 0.
    """
    grid = clinical.select(F.col("projid").alias("sample_id"), "dpt", "msex").crossJoin(nodes)
    a = abundance.select("sample_id", F.col("feature_id").alias("node"), F.col("value").alias("abundance"))
    joined = grid.join(a, ["sample_id", "node"], "left").join(proportions, "sample_id", "left")
    return joined.select("sample_id", "node", F.coalesce("abundance", F.lit(0.0)).alias("abundance"), F.col("dpt").alias("pseudotime"), F.coalesce("proportion", F.lit(0.0)).alias("proportion"), F.when(F.col("msex") == 1, 1.0).otherwise(0.0).alias("sex"), F.col("degree").cast("double").alias("degree"), F.col("betweenness"), F.col("node").isin(genes).cast("double").alias("risk_gene"))


def split(df: DataFrame, id_col: str, seed: int, share: float = 0.7) -> DataFrame:
    """train for the first floor(share * n) rows in the order of (id * (2 seed + 1)) mod 10007, ties by id.

    Rows are counted per key; only the one key at the bound is ranked row by row.
    """
    keyed = df.withColumn("_key", F.pmod(F.col(id_col) * (2 * seed + 1), F.lit(10007)))
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)  # 10,007 keys at most
    placed = counts.select("_key", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.floor(F.lit(share) * F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_most"))
    joined = keyed.join(F.broadcast(placed), "_key")
    sure = joined.where("_before + _n <= _most or _before >= _most").withColumn("train", F.col("_before") < F.col("_most"))
    at = joined.where("_before + _n > _most and _before < _most")
    ranked = at.withColumn("train", F.col("_before") + F.row_number().over(Window.partitionBy("_key").orderBy(id_col)) <= F.col("_most"))
    return sure.unionByName(ranked).select(*df.columns, "train")
