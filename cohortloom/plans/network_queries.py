"""Registered queries on networks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix, network
from ..operators.pairs import nearest
from ..sources import views
from ..sources.views import SQL as V
from .matrix_queries import r6


def minimum_slice(spark, sf_dir):
    """Embeddings to long form, z-scores, |r|, overlap at power 4, and its hundred strongest edges."""
    m = matrix.zscore(views.emb_long(spark, sf_dir))
    tom = network.topological_overlap(network.abs_corr(m), 4)
    return network.top_edges(tom, "tom", 100).withColumn("tom", F.round("tom", 9))


def abs_corr(spark, sf):
    return r6(network.abs_corr(views.emb_long(spark, sf)), "r")


def soft_threshold(spark, sf):
    return r6(network.soft_threshold(network.abs_corr(views.emb_long(spark, sf)), 64), "r2")


def tom(spark, sf):
    return network.topological_overlap(network.abs_corr(views.emb_long(spark, sf)), 2).withColumn("tom", F.round("tom", 9))


def tom_edges(spark, sf):
    t = network.topological_overlap(network.abs_corr(views.emb_long(spark, sf)), 2)
    return network.tom_edges(t, 0.004).withColumn("weight", F.round("weight", 9))


def _layers(spark, sf):
    """Three layers by rules on |r|, and a table of known pairs."""
    c = network.abs_corr(views.emb_long(spark, sf))
    w = c.where("r > 0.03").select("i", "j", F.col("r").alias("w"))
    g = c.where("(i + j) % 3 = 0 and r > 0.02").select("i", "j", F.col("r").alias("w"))
    d = network.both_ways(c, "r").where("(2 * i + j) % 4 = 1 and r > 0.02").select("i", "j", F.col("r").alias("w"))
    known = network.both_ways(c.where("(i * j) % 5 = 0"), "r").select("i", "j")
    return w, g, d, known


def consensus_edges(spark, sf):
    out = network.consensus_edges(*_layers(spark, sf))
    return r6(out.withColumn("n_methods", F.col("n_methods").cast("int")), "wgcna_raw", "glasso_raw", "causal_raw", "total_weight")


def confidence_tiers(spark, sf):
    return network.consensus_edges(*_layers(spark, sf)).groupBy("confidence_tier").agg(F.count("*").alias("n"))


def node_degree(spark, sf):
    return network.degree(network.consensus_edges(*_layers(spark, sf)))


def top_pct_edges(spark, sf):
    return r6(network.top_share(network.abs_corr(views.emb_long(spark, sf)), "r"), "r")


def split_70_30(spark, sf):
    e = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    return network.split(e, "sample_id", 3).select("sample_id", "train")


GENES = [1, 4, 9]


def _node_features(spark, sf):
    c = views.clinical(spark, sf)
    nodes = spark.range(64).select(F.col("id").cast("int").alias("node"), (F.col("id") % 4 + 1).alias("degree"), (F.col("id") / 100.0).alias("betweenness"))
    p = views.clinical(spark, sf).select(F.col("projid").alias("sample_id"), (F.col("projid") % 7 / 10.0).alias("proportion"))
    return network.node_features(views.emb_long(spark, sf), c, p, nodes, GENES)


def node_features(spark, sf):
    return r6(_node_features(spark, sf), "abundance")


def tabular_mean_features(spark, sf):
    f = _node_features(spark, sf)
    names = ["abundance", "pseudotime", "proportion", "sex", "degree", "betweenness", "risk_gene"]
    return f.groupBy("sample_id").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def partitions(spark, sf):
    """Network names "{subtype}_ct_{cell type}" taken apart, and the edges of each."""
    c = network.abs_corr(views.emb_long(spark, sf)).where("r > 0.02")
    named = c.select(F.concat(F.lit("ST"), F.col("i") % 3 + 1, F.lit("_ct_"), F.when(F.col("j") % 2 == 0, "Ex").otherwise("Mic")).alias("network"))
    parts = F.split("network", "_ct_")
    return named.select(parts[0].alias("subtype"), parts[1].alias("cell_type")).groupBy("subtype", "cell_type").agg(F.count("*").alias("edges"))


def knn_graph(spark, sf):
    """The 15 nearest of every sample by Euclidean distance, ties by id."""
    return r6(nearest(matrix.arrays(views.emb_long(spark, sf)), 15), "d")


QUERIES = {f.__name__: f for f in (minimum_slice, abs_corr, soft_threshold, tom, tom_edges, consensus_edges, confidence_tiers, node_degree, top_pct_edges, split_70_30, node_features, tabular_mean_features, partitions, knn_graph)}

_C = "c AS (SELECT a.feature_id AS i, b.feature_id AS j, abs(corr(a.value, b.value)) AS r FROM emb_long a JOIN emb_long b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY ALL)"


def _tom(beta: int) -> str:
    return f"""full_a AS (SELECT i, j, r ** {beta} AS a FROM c UNION ALL SELECT j, i, r ** {beta} FROM c UNION ALL SELECT feature_id, feature_id, 1.0 FROM (SELECT DISTINCT feature_id FROM emb_long)),
      k AS (SELECT i, sum(a) AS k FROM full_a GROUP BY 1), l AS (SELECT x.i, y.j, sum(x.a * y.a) AS l FROM full_a x JOIN full_a y ON x.j = y.i WHERE x.i < y.j GROUP BY ALL),
      t AS (SELECT l.i, l.j, (l + a) / (least(ki.k, kj.k) + 1 - a) AS tom FROM l JOIN full_a USING (i, j) JOIN k ki ON ki.i = l.i JOIN k kj ON kj.i = l.j)"""


_L = f"""{V['emb_long']}, {_C}, w AS (SELECT i, j, r FROM c WHERE r > 0.03), g AS (SELECT i, j, r FROM c WHERE (i + j) % 3 = 0 AND r > 0.02),
  b AS (SELECT i, j, r FROM c UNION ALL SELECT j, i, r FROM c),
  s AS (SELECT i, j, r, 1 AS l FROM w UNION ALL SELECT j, i, r, 1 FROM w UNION ALL SELECT i, j, r, 2 FROM g UNION ALL SELECT j, i, r, 2 FROM g UNION ALL SELECT i, j, r, 3 FROM b WHERE (2 * i + j) % 4 = 1 AND r > 0.02),
  p AS (SELECT i, j, coalesce(max(r) FILTER (l = 1), 0) AS wgcna_raw, coalesce(max(r) FILTER (l = 2), 0) AS glasso_raw, coalesce(max(r) FILTER (l = 3), 0) AS causal_raw, CASE WHEN (i * j) % 5 = 0 THEN 0.15::DOUBLE ELSE 0 END AS bonus FROM s GROUP BY i, j),
  q AS (SELECT *, (wgcna_raw > 0)::INT * 0.30::DOUBLE AS wgcna_w, (glasso_raw > 0)::INT * 0.35::DOUBLE AS glasso_w, (causal_raw > 0)::INT * 0.35::DOUBLE AS causal_w, (wgcna_raw > 0)::INT + (glasso_raw > 0)::INT + (causal_raw > 0)::INT AS n_methods FROM p),
  e AS (SELECT *, wgcna_w + glasso_w + causal_w + bonus AS total_weight,
    CASE WHEN n_methods >= 3 AND bonus > 0 THEN 'Highest' WHEN n_methods >= 3 THEN 'High' WHEN n_methods = 2 THEN 'Moderate' ELSE 'Low' END AS confidence_tier FROM q)"""
_F = f"""{V['emb_long']}, {V['clinical']}, f AS (SELECT projid AS sample_id, node::INT AS node, coalesce(value, 0) AS abundance, dpt AS pseudotime, projid % 7 / 10.0::DOUBLE AS proportion, CASE WHEN msex = 1 THEN 1.0::DOUBLE ELSE 0 END AS sex,
  (node % 4 + 1)::DOUBLE AS degree, node / 100.0::DOUBLE AS betweenness, (node IN (1, 4, 9))::INT::DOUBLE AS risk_gene
  FROM clinical, (SELECT unnest(range(64)) AS node) n LEFT JOIN emb_long ON emb_long.sample_id = projid AND feature_id = node)"""

ORACLE = {
    "minimum_slice": f"WITH {V['emb_long']}, {_C}, {_tom(4)} SELECT i, j, round(tom, 9) AS tom FROM t ORDER BY t.tom DESC, i, j LIMIT 100",
    "abs_corr": f"WITH {V['emb_long']}, {_C} SELECT i, j, round(r, 6) AS r FROM c",
    "soft_threshold": f"""WITH {V['emb_long']}, {_C}, b AS (SELECT unnest([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14])::INT AS beta), two AS (SELECT i, j, r FROM c UNION ALL SELECT j, i, r FROM c),
      k AS (SELECT beta, i, sum(r ** beta) AS k FROM two, b GROUP BY ALL), o AS (SELECT beta, min(k) AS lo, max(k) AS hi, count(*) AS n, (max(k) - min(k)) / 10 AS w FROM k GROUP BY 1),
      d AS (SELECT beta, least(floor((k - lo) / w), 9) AS bin, count(*) AS m, max(n) AS n, max(w) AS w, max(lo) AS lo FROM k JOIN o USING (beta) GROUP BY 1, 2),
      p AS (SELECT beta, log10(lo + (bin + 0.5) * w) AS x, log10(m / (n * w)) AS y FROM d WHERE lo + (bin + 0.5) * w > 0),
      f AS (SELECT beta, count(*) AS bins, CASE WHEN count(*) >= 3 THEN corr(x, y) ** 2 END AS r2 FROM p GROUP BY 1)
      SELECT beta, bins, round(r2, 6) AS r2, (SELECT coalesce(min(beta) FILTER (r2 >= 0.85), 6)::INT FROM f) AS chosen FROM f""",
    "tom": f"WITH {V['emb_long']}, {_C}, {_tom(2)} SELECT i, j, round(tom, 9) AS tom FROM t",
    "tom_edges": f"WITH {V['emb_long']}, {_C}, {_tom(2)} SELECT j AS protein_a, i AS protein_b, round(tom, 9) AS weight, 'wgcna' AS layer, 0.30::DOUBLE AS consensus_weight FROM t WHERE tom > 0.004",
    "consensus_edges": f"WITH {_L} SELECT i, j, round(wgcna_raw, 6) AS wgcna_raw, round(glasso_raw, 6) AS glasso_raw, round(causal_raw, 6) AS causal_raw, wgcna_w, glasso_w, causal_w, bonus, n_methods, round(total_weight, 6) AS total_weight, confidence_tier FROM e",
    "confidence_tiers": f"WITH {_L} SELECT confidence_tier, count(*) AS n FROM e GROUP BY 1",
    "node_degree": f"WITH {_L} SELECT node, count(*) AS degree FROM (SELECT i AS node FROM e UNION ALL SELECT j FROM e) GROUP BY 1",
    "top_pct_edges": f"WITH {V['emb_long']}, {_C}, k AS (SELECT *, row_number() OVER (ORDER BY r DESC, i, j) AS n, count(*) OVER () AS total FROM c WHERE r > 1e-4) SELECT i, j, round(r, 6) AS r FROM k WHERE n <= floor(total * 0.05)",
    "split_70_30": "SELECT vec_id AS sample_id, row_number() OVER (ORDER BY (vec_id * 7) % 10007, vec_id) <= floor(0.7 * count(*) OVER ()) AS train FROM embeddings",
    "node_features": f"WITH {_F} SELECT * REPLACE (round(abundance, 6) AS abundance) FROM f",
    "tabular_mean_features": f"WITH {_F} SELECT sample_id, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("abundance", "pseudotime", "proportion", "sex", "degree", "betweenness", "risk_gene")) + " FROM f GROUP BY 1",
    "partitions": f"WITH {V['emb_long']}, {_C} SELECT 'ST' || (i % 3 + 1) AS subtype, CASE WHEN j % 2 = 0 THEN 'Ex' ELSE 'Mic' END AS cell_type, count(*) AS edges FROM c WHERE r > 0.02 GROUP BY ALL",
    "knn_graph": f"""WITH {V['emb_long']}, d AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM emb_long a JOIN emb_long b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id GROUP BY ALL)
      SELECT i, j, round(d, 6) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d QUALIFY rank <= 15""",
}
