"""Registered queries on patients, ranks and survival, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, matrix, stats
from ..sources import views
from ..sources.views import SQL as V
from .matrix_queries import r6


def sample_join(spark, sf):
    m, c = views.spend_type(spark, sf), views.clinical(spark, sf)
    return m.join(c, m.sample_id == c.projid).groupBy("diagnosis").agg(F.count("*").alias("cells"), F.count_distinct("sample_id").alias("samples"), F.round(F.sum("value"), 2).alias("total"))


def sample_semi(spark, sf):
    c = views.clinical(spark, sf).where("diagnosis = 'AD'")
    m = views.spend_type(spark, sf)
    return m.join(c, m.sample_id == c.projid, "left_semi").groupBy("feature_id").agg(F.count("*").alias("cells"))


def patient_class(spark, sf):
    return cohort.classify_patients(views.clinical(spark, sf)).select("projid", "patient_class")


def class_counts(spark, sf):
    return cohort.classify_patients(views.clinical(spark, sf)).groupBy("patient_class").agg(F.count("*").alias("n"))


def update_join(spark, sf):
    master = cohort.classify_patients(views.clinical(spark, sf))
    subtypes = cohort.subtype_cohort(master).select("projid", F.concat(F.lit("ST"), F.col("projid") % 3 + 1).alias("subtype"))
    return cohort.update_column(master, subtypes, "projid", "subtype").select("projid", "patient_class", "subtype")


def master_left_join(spark, sf):
    """The clinical table with each sample's mean value and cells; samples without any have NULL."""
    m = views.spend_type(spark, sf).groupBy(F.col("sample_id").alias("projid")).agg(F.count("*").alias("cells"), F.round(F.avg("value"), 4).alias("mean"))
    return views.clinical(spark, sf).join(m, "projid", "left").select("projid", "diagnosis", "cells", "mean")


def matrix_orientation(spark, sf):
    """Rows and columns of the wide form and whether the rule takes its rows for features."""
    n = views.spend_type(spark, sf).agg(F.count_distinct("sample_id").alias("n_rows"), F.count_distinct("feature_id").alias("n_cols"))
    return n.select("n_rows", "n_cols", ((F.col("n_rows") > F.col("n_cols")) & (F.col("n_rows") > 1000)).alias("transposed"))


def survival_prep(spark, sf):
    return cohort.survival_inputs(views.clinical(spark, sf)).select("projid", F.round("t", 6).alias("t"), F.col("event").cast("int").alias("event"), "stage")


def survival_linear(spark, sf):
    return r6(stats.survival_linear(views.survival(spark, sf), "grp", "t"), "level_first", "level_last")


def survival_product_limit(spark, sf):
    return r6(stats.product_limit(views.survival(spark, sf), "grp", "t", "event"), "survival")


def spearman_validation(spark, sf):
    """One row per measure; rho with pseudotime and both readings of the pass rule."""
    out = stats.time_validation(views.clinical(spark, sf), "dpt", {m: m for m, _, _ in stats.EXPECTED})
    coded = F.when(F.col("sign") < 0, F.col("rho") < 0.30).otherwise(F.col("rho") > 0.30)
    meant = F.when(F.col("sign") < 0, F.col("rho") < -0.30).otherwise(F.col("rho") > 0.30)
    return r6(out.select("measure", "n", "rho", coded.alias("pass_as_coded"), meant.alias("pass_as_documented")), "rho")


def kruskal_h(spark, sf):
    return r6(stats.kruskal(views.survival(spark, sf), "grp", "t"), "h")


def mannwhitney_u(spark, sf):
    return stats.mann_whitney(views.survival(spark, sf), "grp", "t", 0, 1)


def kruskal_test(spark, sf):
    return r6(stats.kruskal_test(views.survival(spark, sf), "grp", "t"), "h", "p")


def mannwhitney_test(spark, sf):
    """z against SQL; its p-value is the normal tail."""
    return r6(stats.mann_whitney_test(views.survival(spark, sf), "grp", "t", 0, 1), "z", "p")


def mannwhitney_z(spark, sf):
    return r6(stats.mann_whitney_test(views.survival(spark, sf), "grp", "t", 0, 1).drop("p"), "z")


def _path(spark, sf):
    """Ten penalties with the share of events of some kind as their instability."""
    e = views.read(spark, sf, "events")
    return e.groupBy((1 / (1 + F.col("event_id") % 10)).alias("lambda")).agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("instability"))


def lambda_walk(spark, sf):
    """The penalty at several bounds, of which the lowest is passed by the largest penalty already."""
    rows = [cohort.running_lambda(_path(spark, sf), b).select(F.lit(b).alias("bound"), F.round("lambda", 6).alias("lambda")) for b in (0.0, 0.2, 0.21, 1.0)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def k_choice(spark, sf):
    """The k of the best candidates under several bounds on their correlation; candidates are customers' nations."""
    c = views.read(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("int").alias("k")).agg((F.avg("c_acctbal") / 10_000).alias("cophenetic"), F.count("*").alias("min_cluster"))
    rows = [cohort.select_k(c, b, 5).select(F.lit(b).alias("bound"), "k") for b in (0.0, 0.4, 0.45, 2.0)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def mean_jaccard(spark, sf):
    """Stability of the runs in one number."""
    sets = _top(spark, sf).groupBy("run").agg(F.collect_set("feature_id").alias("members"))
    return stats.pair_jaccard(sets, "run", "members").agg(F.count("*").alias("pairs"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


def boxplot_stats(spark, sf):
    q = views.survival(spark, sf).groupBy("grp").agg(F.expr("percentile(t, array(0.25, 0.5, 0.75))").alias("q"))
    return q.select("grp", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def _proportions(m):
    total = m.groupBy("sample_id").agg(F.sum("value").alias("t"))
    return m.join(total, "sample_id").select("sample_id", F.col("feature_id").alias("cell_type"), (F.col("value") / F.col("t")).alias("proportion"))


def composition(spark, sf):
    """Mean proportion of each cell type by patient class, and which type is each sample's greatest."""
    p = _proportions(views.spend_type(spark, sf))
    c = cohort.classify_patients(views.clinical(spark, sf)).select(F.col("projid").alias("sample_id"), "patient_class")
    return r6(p.join(c, "sample_id").groupBy("patient_class", "cell_type").agg(F.avg("proportion").alias("mean")), "mean")


def dominant_type(spark, sf):
    return cohort.argmax(_proportions(views.spend_type(spark, sf)), "sample_id", "cell_type", "proportion")


def subtype_labels(spark, sf):
    c = views.clinical(spark, sf).select(F.concat(F.lit("ST"), F.col("projid") % 3 + 1).alias("subtype"), "dpt", (F.col("projid") % 5 / 10.0).alias("ct_Ast"), (F.col("projid") % 7 / 10.0).alias("ct_Ex"), (F.col("projid") % 3 / 10.0).alias("ct_Mic"))
    return cohort.name_subtypes(c)


def consensus_matrix(spark, sf):
    return cohort.consensus_matrix(views.runs(spark, sf), 6)


def silhouette(spark, sf):
    labels = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    return r6(stats.silhouette(matrix.shift_nonnegative(views.emb_long(spark, sf)), labels), "s")


def subtype_sizes(spark, sf):
    return views.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


def root_select(spark, sf):
    points = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding")[0].cast("double").alias("d0"), F.col("embedding")[1].cast("double").alias("d1"))
    return cohort.root_cell(points, views.clinical(spark, sf))


def auroc(spark, sf):
    e = views.read(spark, sf, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.floor("value").alias("score"))
    return r6(stats.auroc(e, "y", "score"), "auroc")


def _top(spark, sf):
    """The five features of the greatest mean in each of four id classes, as runs."""
    m = views.emb_long(spark, sf).groupBy((F.col("sample_id") % 4).alias("run"), "feature_id").agg(F.avg("value").alias("imp"))
    ranked = m.withColumn("r", F.expr("row_number() over (partition by run order by imp desc, feature_id)")).where("r <= 20")
    return ranked


def jaccard(spark, sf):
    sets = _top(spark, sf).groupBy("run").agg(F.collect_set("feature_id").alias("members"))
    return r6(stats.pair_jaccard(sets, "run", "members"), "jaccard")


def stability_counts(spark, sf):
    return _top(spark, sf).groupBy("feature_id").agg(F.count("*").alias("hits")).select("feature_id", (F.col("hits") / 4.0).alias("frequency"), (F.col("hits") >= int(0.6 * 4)).alias("is_stable"))


def mse(spark, sf):
    li = views.read(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("p"))
    bce = -(F.when(F.col("y") > 0.5, F.ln(1 / (1 + F.exp(-F.col("p"))))).otherwise(F.ln(1 - 1 / (1 + F.exp(-F.col("p"))))))
    return li.agg(F.round(F.avg(F.pow(F.col("y") - F.col("p"), 2)), 6).alias("mse"), F.round(0.7 * F.avg(bce) + 0.3 * F.avg(F.pow(F.col("y") - F.col("p"), 2)), 6).alias("dual_loss"))


QUERIES = {f.__name__: f for f in (sample_join, sample_semi, patient_class, class_counts, update_join, master_left_join, matrix_orientation, survival_prep, survival_linear, survival_product_limit, spearman_validation, kruskal_h, mannwhitney_u, kruskal_test, mannwhitney_test, mannwhitney_z, lambda_walk, k_choice, mean_jaccard, boxplot_stats, composition, dominant_type, subtype_labels, consensus_matrix, silhouette, subtype_sizes, root_select, auroc, jaccard, stability_counts, mse)}

_CLASS = """cls AS (SELECT *, CASE WHEN braaksc IS NULL OR ceradsc IS NULL THEN CASE WHEN diagnosis = 'Control' THEN 'Healthy Control' ELSE 'Clinical AD' END
  WHEN NOT (diagnosis = 'Control' OR coalesce(cogdx = 1, false)) THEN 'Clinical AD' WHEN braaksc >= 3 AND ceradsc >= 3 THEN 'AsymAD' ELSE 'Healthy Control' END AS patient_class FROM clinical)"""
_RANK = "avg_rank AS (SELECT *, (rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE) AS r FROM {0})"
_SPEAR = """SELECT '{0}' AS measure, count(*) AS n, round(corr(rx, ry), 6) AS rho, corr(rx, ry) {1} AS pass_as_coded, corr(rx, ry) {2} AS pass_as_documented FROM (
  SELECT rank() OVER (ORDER BY dpt) + (count(*) OVER (PARTITION BY dpt) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE AS ry FROM clinical WHERE {0} IS NOT NULL)"""
_PROP = "prop AS (SELECT sample_id, feature_id AS cell_type, value / sum(value) OVER (PARTITION BY sample_id) AS proportion FROM spend_type)"
_TOP = """imp AS (SELECT sample_id % 4 AS run, feature_id, avg(value) AS imp FROM emb_long GROUP BY ALL), top AS (SELECT * FROM imp QUALIFY row_number() OVER (PARTITION BY run ORDER BY imp DESC, feature_id) <= 20)"""

ORACLE = {
    "sample_join": f"WITH {V['spend_type']}, {V['clinical']} SELECT diagnosis, count(*) AS cells, count(DISTINCT sample_id) AS samples, round(sum(value), 2) AS total FROM spend_type JOIN clinical ON sample_id = projid GROUP BY 1",
    "sample_semi": f"WITH {V['spend_type']}, {V['clinical']} SELECT feature_id, count(*) AS cells FROM spend_type WHERE sample_id IN (SELECT projid FROM clinical WHERE diagnosis = 'AD') GROUP BY 1",
    "patient_class": f"WITH {V['clinical']}, {_CLASS} SELECT projid, patient_class FROM cls",
    "class_counts": f"WITH {V['clinical']}, {_CLASS} SELECT patient_class, count(*) AS n FROM cls GROUP BY 1",
    "update_join": f"WITH {V['clinical']}, {_CLASS} SELECT projid, patient_class, CASE WHEN patient_class = 'Clinical AD' THEN 'ST' || (projid % 3 + 1) END AS subtype FROM cls",
    "master_left_join": f"WITH {V['spend_type']}, {V['clinical']}, m AS (SELECT sample_id, count(*) AS cells, round(avg(value), 4) AS mean FROM spend_type GROUP BY 1) SELECT projid, diagnosis, cells, mean FROM clinical LEFT JOIN m ON sample_id = projid",
    "matrix_orientation": f"WITH {V['spend_type']} SELECT count(DISTINCT sample_id) AS n_rows, count(DISTINCT feature_id) AS n_cols, n_rows > n_cols AND n_rows > 1000 AS transposed FROM spend_type",
    "survival_prep": f"WITH {V['clinical']} SELECT projid, round((1 - dpt) * 100, 6) AS t, (coalesce(braaksc >= 4, false) OR coalesce(mmse < 20, false))::INT AS event, CASE WHEN dpt < 0.33 THEN 'Early' WHEN dpt < 0.67 THEN 'Intermediate' ELSE 'Advanced' END AS stage FROM clinical",
    "survival_linear": f"""WITH {V['survival']}, o AS (SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY t) AS k, count(*) OVER (PARTITION BY grp) AS n FROM survival)
      SELECT grp, t, count(*) AS m, round(max(CASE WHEN n > 1 THEN 1 - (k - 1) / (n - 1)::DOUBLE ELSE 1 END), 6) AS level_first, round(min(CASE WHEN n > 1 THEN 1 - (k - 1) / (n - 1)::DOUBLE ELSE 1 END), 6) AS level_last FROM o GROUP BY ALL""",
    "survival_product_limit": f"""WITH {V['survival']}, c AS (SELECT grp, t, count(*) AS m, sum(event)::BIGINT AS deaths FROM survival GROUP BY ALL),
      r AS (SELECT *, sum(m) OVER (PARTITION BY grp ORDER BY t DESC)::BIGINT AS at_risk FROM c), e AS (SELECT * FROM r WHERE deaths > 0)
      SELECT grp, t, at_risk, deaths, round(CASE WHEN max((deaths >= at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk::DOUBLE) ELSE 0 END) OVER w) END, 6) AS survival FROM e WINDOW w AS (PARTITION BY grp ORDER BY t)""",
    "spearman_validation": f"WITH {V['clinical']} " + " UNION ALL ".join(_SPEAR.format(m, *(("< 0.30", "< -0.30") if s < 0 else ("> 0.30", "> 0.30"))) for m, s in (("mmse", -1), ("braaksc", 1), ("ceradsc", -1), ("cogdx", 1))),
    "kruskal_h": f"""WITH {V['survival']}, {_RANK.format('survival')}, g AS (SELECT grp, sum(r) AS s, count(*) AS m FROM avg_rank GROUP BY 1), ties AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM survival GROUP BY t)),
      a AS (SELECT sum(m)::DOUBLE AS n, count(*) AS groups, sum(s * s / m) AS q FROM g)
      SELECT n::BIGINT AS n, groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h FROM a, ties""",
    "mannwhitney_u": f"WITH {V['survival']}, two AS (SELECT * FROM survival WHERE grp IN (0, 1)), {_RANK.format('two')} SELECT count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2, sum(r) FILTER (grp = 0) - count(*) FILTER (grp = 0) * (count(*) FILTER (grp = 0) + 1) / 2 AS u FROM avg_rank",
    "boxplot_stats": f"WITH {V['survival']} SELECT grp, round(quantile_cont(t, 0.25), 6) AS q1, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.75), 6) AS q3 FROM survival GROUP BY 1",
    "composition": f"WITH {V['spend_type']}, {V['clinical']}, {_CLASS}, {_PROP} SELECT patient_class, cell_type, round(avg(proportion), 6) AS mean FROM prop JOIN cls ON sample_id = projid GROUP BY ALL",
    "dominant_type": f"WITH {V['spend_type']}, {_PROP} SELECT sample_id, cell_type FROM prop QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY proportion DESC, cell_type) = 1",
    "subtype_labels": f"""WITH {V['clinical']}, m AS (SELECT 'ST' || (projid % 3 + 1) AS subtype, avg(dpt) AS dpt, avg(projid % 5 / 10.0::DOUBLE) AS a, avg(projid % 7 / 10.0::DOUBLE) AS e, avg(projid % 3 / 10.0::DOUBLE) AS i FROM clinical GROUP BY 1)
      SELECT subtype, CASE WHEN a = greatest(a, e, i) THEN 'Ast' WHEN e = greatest(a, e, i) THEN 'Ex' ELSE 'Mic' END || '-enriched (' || CASE WHEN dpt < 0.33 THEN 'Early' WHEN dpt < 0.67 THEN 'Intermediate' ELSE 'Advanced' END || ')' AS name FROM m""",
    "consensus_matrix": f"WITH {V['runs']} SELECT a.sample_id AS i, b.sample_id AS j, round(count(*) / 6.0::DOUBLE, 6) AS share FROM runs a JOIN runs b ON a.run = b.run AND a.label = b.label AND a.sample_id < b.sample_id GROUP BY ALL",
    "silhouette": f"""WITH {V['emb_long']}, d AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM emb_long a JOIN emb_long b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id GROUP BY ALL),
      p AS (SELECT i, x.label AS li, y.label AS lj, avg(d) AS d FROM d JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j GROUP BY ALL),
      ab AS (SELECT i, li, min(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM p GROUP BY ALL)
      SELECT i AS sample_id, li AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM ab""",
    "subtype_sizes": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
    "root_select": f"""WITH {V['clinical']}, p AS (SELECT vec_id AS sample_id, embedding[1]::DOUBLE AS d0, embedding[2]::DOUBLE AS d1 FROM embeddings), m AS (SELECT avg(d0) AS a, avg(d1) AS b FROM p),
      c AS (SELECT sample_id, sqrt((d0 - a) * (d0 - a) + (d1 - b) * (d1 - b)) AS d FROM p, m WHERE sample_id IN (SELECT projid FROM clinical WHERE cogdx = 1 AND braaksc <= 1))
      SELECT coalesce((SELECT sample_id FROM c ORDER BY d, sample_id LIMIT 1), (SELECT min(sample_id) FROM p)) AS root""",
    "auroc": """WITH e AS (SELECT (event_type = 'purchase')::INT AS y, floor(value) AS t FROM events), r AS (SELECT y, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS r FROM e)
      SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, round(coalesce((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif((count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 0), 0.5), 6) AS auroc FROM r""",
    "jaccard": f"""WITH {V['emb_long']}, {_TOP} SELECT a.run AS run_a, b.run AS run_b, round(count(*) FILTER (a.feature_id = b.feature_id) / (40 - count(*) FILTER (a.feature_id = b.feature_id))::DOUBLE, 6) AS jaccard FROM top a JOIN top b ON a.run < b.run GROUP BY ALL""",
    "stability_counts": f"WITH {V['emb_long']}, {_TOP} SELECT feature_id, count(*) / 4.0::DOUBLE AS frequency, count(*) >= 2 AS is_stable FROM top GROUP BY 1",
    "mse": """WITH x AS (SELECT l_discount * 10 AS y, l_tax * 10 AS p FROM lineitem) SELECT round(avg(pow(y - p, 2)), 6) AS mse,
      round(0.7 * avg(-CASE WHEN y > 0.5 THEN ln(1 / (1 + exp(-p))) ELSE ln(1 - 1 / (1 + exp(-p))) END) + 0.3 * avg(pow(y - p, 2)), 6) AS dual_loss FROM x""",
}
ORACLE["kruskal_test"] = "WITH q AS (" + ORACLE["kruskal_h"].replace("round((12", "((12").replace("), 6) AS h", ")) AS h") + ") SELECT n, groups, round(h, 6) AS h, round(exp(-h / 2), 6) AS p FROM q"
ORACLE["mannwhitney_z"] = "WITH q AS (" + ORACLE["mannwhitney_u"] + """), ties AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM events WHERE user_id % 3 IN (0, 1) GROUP BY floor(value))),
  a AS (SELECT *, n1 * n2 / 2.0::DOUBLE AS mid, (n1 + n2)::DOUBLE AS n FROM q)
  SELECT n1, n2, u, round(sign(u - mid) * greatest(abs(u - mid) - 0.5, 0) / sqrt(n1 * n2 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM a, ties"""
ORACLE["lambda_walk"] = """WITH p AS (SELECT 1 / (1 + event_id % 10)::DOUBLE AS l, avg((event_type = 'purchase')::INT) AS i FROM events GROUP BY 1), b AS (SELECT unnest([0.0, 0.2, 0.21, 1.0])::DOUBLE AS bound),
  first_bad AS (SELECT bound, max(l) FILTER (i > bound) AS bad FROM p, b GROUP BY 1)
  SELECT bound, round(coalesce((SELECT min(l) FROM p WHERE l > coalesce(bad, 0)), (SELECT max(l) FROM p)), 6) AS lambda FROM first_bad"""
ORACLE["k_choice"] = """WITH c AS (SELECT c_nationkey::INT AS k, avg(c_acctbal) / 10000 AS r, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT unnest([0.0, 0.4, 0.45, 2.0])::DOUBLE AS bound)
  SELECT bound, coalesce((SELECT k FROM c WHERE r > bound AND n >= 5 ORDER BY r DESC, k LIMIT 1), 2)::INT AS k FROM b"""
ORACLE["mean_jaccard"] = "SELECT count(*) AS pairs, round(avg(jaccard), 6) AS mean_jaccard FROM (" + ORACLE["jaccard"].replace(", 6) AS jaccard", ", 12) AS jaccard") + ")"
