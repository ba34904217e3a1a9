"""Registered queries on matrices, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deconv, matrix
from ..sources import views
from ..sources.views import SQL as V

def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def types_of(spark, sf):
    """The part types, in order (six; a fixed dimension)."""
    return sorted(r[0] for r in views.read(spark, sf, "part").select("p_type").distinct().collect())


def missing_pct(spark, sf):
    return r6(matrix.missing_pct(views.spend_brand(spark, sf)), "missing_pct")


def qc_filter(spark, sf):
    return matrix.qc_filter(views.spend_brand(spark, sf), 23.5).groupBy("feature_id").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 2).alias("total"))


def knn_impute(spark, sf):
    return r6(matrix.knn_impute(views.spend_type(spark, sf)), "value")


def log2_transform(spark, sf):
    return r6(matrix.log2_transform(views.spend_type(spark, sf)), "value")


def zscore(spark, sf):
    return r6(matrix.zscore(views.emb_long(spark, sf)), "value")


def residualise(spark, sf):
    cov = views.read(spark, sf, "embeddings").selectExpr("vec_id as sample_id", "60 + (vec_id * 13) % 40 as age_death", "vec_id % 2 as msex", "case when vec_id % 11 = 0 then null else cast((vec_id * 11) % 280 as double) / 10 end as pmi")
    return r6(matrix.residualise(views.emb_long(spark, sf), cov, ["age_death", "msex", "pmi", "absent"]), "value")


def category_codes(spark, sf):
    df = views.read(spark, sf, "customer").select("c_custkey", F.expr("case when c_custkey % 9 = 0 then null else c_mktsegment end").alias("segment"))
    return matrix.category_codes(df, "segment", "code").select("c_custkey", F.col("code").cast("long"))


def mean_fill(spark, sf):
    return r6(matrix.mean_fill(views.spend_type(spark, sf)), "value")


def nonneg_shift(spark, sf):
    return r6(matrix.shift_nonnegative(views.emb_long(spark, sf)), "value")


def top_variable(spark, sf):
    return r6(matrix.top_variable(views.emb_long(spark, sf), 20).withColumn("rank", F.col("rank").cast("long")), "variance")


def matrix_unpivot(spark, sf):
    wide = matrix.pivot(views.emb_long(spark, sf), list(range(64)))
    return r6(matrix.unpivot(wide).withColumn("feature_id", F.col("feature_id").cast("int")), "value")


def matrix_pivot(spark, sf):
    names = [f"f{i}" for i in range(64)]
    m = views.emb_long(spark, sf).withColumn("feature_id", F.concat(F.lit("f"), F.col("feature_id")))
    return r6(matrix.pivot(m, names), *names)


def histogram(spark, sf):
    df = views.read(spark, sf, "customer").select("c_acctbal")
    return r6(matrix.histogram(df, "c_acctbal", 30), "density")


def reference_profiles(spark, sf):
    return r6(deconv.reference_profiles(views.cells(spark, sf)), "value")


def _shares(m):
    return m.groupBy("sample_id").agg(F.sum("value").alias("t")).join(m, "sample_id").select("sample_id", F.col("feature_id").alias("cell_type"), (F.col("value") / F.col("t")).alias("proportion"))


def celltype_profiles(spark, sf):
    return deconv.celltype_profiles(views.spend_brand(spark, sf), _shares(views.spend_type(spark, sf))).withColumn("abundance", F.round("abundance", 3))


def marker_purity(spark, sf):
    types = types_of(spark, sf)
    brands = sorted(r[0] for r in views.read(spark, sf, "part").select("p_brand").distinct().collect())
    markers = spark.createDataFrame([(t, b) for i, t in enumerate(types[:-1]) for b in brands[4 * i : 4 * i + 4]], "cell_type string, feature_id string")
    lines, parts = views.read(spark, sf, "lineitem"), views.read(spark, sf, "part")
    profiles = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy(F.col("p_type").alias("cell_type"), F.col("p_brand").alias("feature_id")).agg(F.avg("l_quantity").alias("abundance"))
    return r6(deconv.marker_purity(profiles, markers).withColumn("n_markers", F.col("n_markers").cast("long")), "purity")


def nnls_proportions(spark, sf):
    cells = views.cells(spark, sf)
    reference = matrix.arrays(deconv.reference_profiles(cells).select(F.col("cell_type").alias("sample_id"), F.col("gene_id").alias("feature_id"), "value")).withColumnRenamed("sample_id", "cell_type")
    bulk = cells.select(F.substring_index("cell_id", "-", 1).cast("long").alias("sample_id"), F.col("gene_id").alias("feature_id"), "value").groupBy("sample_id", "feature_id").agg(F.avg("value").alias("value"))
    return r6(deconv.proportions(matrix.arrays(bulk), reference), "proportion")


QUERIES = {f.__name__: f for f in (missing_pct, qc_filter, knn_impute, log2_transform, zscore, residualise, category_codes, mean_fill, nonneg_shift, top_variable, matrix_unpivot, matrix_pivot, histogram, reference_profiles, celltype_profiles, marker_purity, nnls_proportions)}

_MISS = "miss AS (SELECT feature_id, ((SELECT count(DISTINCT sample_id) FROM spend_brand) - count(*)) * 100.0::DOUBLE / (SELECT count(DISTINCT sample_id) FROM spend_brand) AS missing_pct FROM spend_brand GROUP BY feature_id)"
_COV = """cov AS (SELECT vec_id AS sample_id, (60 + (vec_id * 13) % 40)::DOUBLE AS c1, (vec_id % 2)::DOUBLE AS c2,
  coalesce(CASE WHEN vec_id % 11 = 0 THEN NULL ELSE ((vec_id * 11) % 280)::DOUBLE / 10 END, (SELECT avg(((vec_id * 11) % 280)::DOUBLE / 10) FROM embeddings WHERE vec_id % 11 <> 0)) AS c3 FROM embeddings)"""

ORACLE = {
    "missing_pct": f"WITH {V['spend_brand']}, {_MISS} SELECT feature_id, round(missing_pct, 6) AS missing_pct FROM miss",
    "qc_filter": f"WITH {V['spend_brand']}, {_MISS} SELECT feature_id, count(*) AS cells, round(sum(value), 2) AS total FROM spend_brand JOIN miss USING (feature_id) WHERE missing_pct <= 23.5 GROUP BY feature_id",
    "knn_impute": f"""WITH {V['spend_type']}, f AS (SELECT DISTINCT feature_id FROM spend_type), p AS (SELECT count(*) AS p FROM f),
      short AS (SELECT sample_id FROM spend_type GROUP BY sample_id HAVING count(*) < (SELECT p FROM p)),
      missing AS (SELECT s.sample_id, f.feature_id FROM short s, f WHERE NOT EXISTS (SELECT 1 FROM spend_type t WHERE t.sample_id = s.sample_id AND t.feature_id = f.feature_id)),
      dist AS (SELECT a.sample_id, b.sample_id AS donor, sqrt((SELECT p FROM p) * avg((a.value - b.value) * (a.value - b.value))) AS d
        FROM spend_type a JOIN short USING (sample_id) JOIN spend_type b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id GROUP BY ALL),
      near AS (SELECT m.sample_id, m.feature_id, d, b.value AS vb, row_number() OVER (PARTITION BY m.sample_id, m.feature_id ORDER BY d, donor) AS r
        FROM missing m JOIN dist USING (sample_id) JOIN spend_type b ON b.sample_id = donor AND b.feature_id = m.feature_id)
      SELECT sample_id, feature_id, round(coalesce(avg(CASE WHEN d = 0 THEN vb END), sum(CASE WHEN d > 0 THEN vb / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)), 6) AS value
      FROM near WHERE r <= 5 GROUP BY ALL""",
    "log2_transform": f"WITH {V['spend_type']} SELECT sample_id, feature_id, round(log2(value + 1), 6) AS value FROM spend_type",
    "zscore": f"WITH {V['emb_long']} SELECT sample_id, feature_id, round((value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1), 6) AS value FROM emb_long WINDOW w AS (PARTITION BY feature_id)",
    "residualise": f"""WITH {V['emb_long']}, {_COV},
      x AS (SELECT sample_id, feature_id, value, c1, c2, c3, c1 - avg(c1) OVER w AS o1, c2 - avg(c2) OVER w AS m2, c3 - avg(c3) OVER w AS m3, value - avg(value) OVER w AS r FROM emb_long JOIN cov USING (sample_id) WINDOW w AS (PARTITION BY feature_id)),
      y AS (SELECT *, m2 - sum(m2 * o1) OVER w / sum(o1 * o1) OVER w * o1 AS o2 FROM x WINDOW w AS (PARTITION BY feature_id)),
      z AS (SELECT *, m3 - sum(m3 * o1) OVER w / sum(o1 * o1) OVER w * o1 - sum(m3 * o2) OVER w / sum(o2 * o2) OVER w * o2 AS o3 FROM y WINDOW w AS (PARTITION BY feature_id))
      SELECT sample_id, feature_id, round(r - sum(r * o1) OVER w / sum(o1 * o1) OVER w * o1 - sum(r * o2) OVER w / sum(o2 * o2) OVER w * o2 - sum(r * o3) OVER w / sum(o3 * o3) OVER w * o3, 6) AS value FROM z WINDOW w AS (PARTITION BY feature_id)""",
    "category_codes": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN -1 ELSE (SELECT count(DISTINCT o.c_mktsegment) FROM customer o WHERE o.c_custkey % 9 <> 0 AND o.c_mktsegment < c.c_mktsegment) END::BIGINT AS code FROM customer c",
    "mean_fill": f"""WITH {V['spend_type']}, g AS (SELECT * FROM (SELECT DISTINCT sample_id FROM spend_type), (SELECT DISTINCT feature_id FROM spend_type)), m AS (SELECT feature_id, avg(value) AS mean FROM spend_type GROUP BY 1)
      SELECT sample_id, feature_id, round(coalesce(value, mean), 6) AS value FROM g LEFT JOIN spend_type USING (sample_id, feature_id) JOIN m USING (feature_id)""",
    "nonneg_shift": f"WITH {V['emb_long']}, e AS (SELECT * FROM emb_long) SELECT sample_id, feature_id, round(CASE WHEN (SELECT min(value) FROM e) < 0 THEN value - (SELECT min(value) FROM e) + 0.01::DOUBLE ELSE value END, 6) AS value FROM e",
    "top_variable": f"WITH {V['emb_long']}, v AS (SELECT feature_id, var_samp(value) AS variance FROM emb_long GROUP BY 1) SELECT feature_id, round(variance, 6) AS variance, row_number() OVER (ORDER BY variance DESC, feature_id) AS rank FROM v QUALIFY rank <= 20",
    "matrix_unpivot": f"WITH {V['emb_long']} SELECT sample_id, feature_id, round(value, 6) AS value FROM emb_long",
    "matrix_pivot": "SELECT vec_id AS sample_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS f{i}" for i in range(64)) + " FROM embeddings",
    "histogram": """WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer)
      SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n, round(count(*) / (max(b.n) * max((hi - lo) / 30)), 6) AS density FROM customer, b GROUP BY 1""",
    "reference_profiles": f"WITH {V['cells']} SELECT cell_type, gene_id, round(avg(value), 6) AS value FROM cells GROUP BY ALL",
    "celltype_profiles": f"""WITH {V['spend_type']}, {V['spend_brand']}, s AS (SELECT sample_id, feature_id AS cell_type, value / sum(value) OVER (PARTITION BY sample_id) AS proportion FROM spend_type)
      SELECT sample_id, feature_id, cell_type, round(value * proportion, 3) AS abundance FROM spend_brand JOIN s USING (sample_id)""",
    "marker_purity": """WITH t AS (SELECT p_type AS cell_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)),
      mk AS (SELECT t.cell_type AS marker_of, p_brand FROM t JOIN b ON b.i // 4 = t.i WHERE t.i < (SELECT max(i) FROM t)),
      pr AS (SELECT p_type AS cell_type, p_brand, avg(l_quantity) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
      me AS (SELECT marker_of, cell_type, avg(a) AS m, count(DISTINCT p_brand) AS k FROM pr JOIN mk USING (p_brand) GROUP BY ALL),
      pe AS (SELECT x.cell_type, coalesce(max(k) FILTER (y.cell_type = x.cell_type), 0) AS n_markers, max(m) FILTER (y.cell_type = x.cell_type) AS own, avg(coalesce(m, 0)) FILTER (y.cell_type <> x.cell_type) AS others
        FROM t x CROSS JOIN t y LEFT JOIN me ON me.marker_of = x.cell_type AND me.cell_type = y.cell_type GROUP BY 1),
      pu AS (SELECT cell_type, n_markers, CASE WHEN n_markers > 0 THEN own / (own + others + 1e-8) ELSE 0 END AS purity FROM pe)
      SELECT cell_type, n_markers, round(purity, 6) AS purity, CASE WHEN n_markers = 0 THEN 'MISSING' WHEN purity > 0.6 THEN 'PASS' ELSE 'LOW_CONFIDENCE' END AS status FROM pu""",
}
