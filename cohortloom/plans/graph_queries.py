"""Registered queries on neighbour graphs and on sparse precision networks, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import cohort, factor, forest, lasso, matrix, network, pairs
from ..sources import views
from ..sources.views import SQL as V
from .matrix_queries import r6


def knn_weights(spark, sf):
    """The fuzzy weights of the graph of the 15 nearest."""
    return r6(pairs.fuzzy_weights(pairs.nearest(matrix.arrays(views.emb_long(spark, sf)), 15), 15), "w")


def _networks(spark, sf):
    """Embeddings as the samples of three networks of unequal size: a twentieth, two twentieths and the rest."""
    part = F.col("sample_id") % 20
    grp = F.when(part == 0, "small").when(part <= 2, "middle").otherwise("large")
    return views.emb_long(spark, sf).withColumn("grp", grp)


def _sixteen(spark, sf):
    """The first sixteen features of the networks, of which the covariances are listed."""
    return _networks(spark, sf).where(F.col("feature_id") < 16)


def fold_covariances(spark, sf):
    """Covariances of all but a fold, for every network and fold, by the deviations of all its samples."""
    return r6(lasso.folded(_sixteen(spark, sf), ["grp"]).covariances("train"), "cov")


def subsample_covariances(spark, sf):
    """Covariances of every network's twenty subsamples of 80 %, by their own deviations."""
    return r6(lasso.subsampled(_sixteen(spark, sf), ["grp"]).covariances("subsample"), "cov")


def glasso_networks(spark, sf):
    """Edges of every network by the arm of its size."""
    return lasso.networks(_networks(spark, sf), ["grp"]).withColumn("weight", F.round("weight", 3))


def glasso_edges(spark, sf):
    """Edges of the sparse precision matrix, one network per label class; penalty 0.1, weights |precision|."""
    m = views.emb_long(spark, sf).withColumn("grp", (F.col("sample_id") % 3).cast("int"))
    return lasso.fixed(m, ["grp"], 0.1).select("grp", "i", "j", F.round("weight", 5).alias("weight"))


def stars_lambda(spark, sf, subsamples=20):
    """The penalty chosen by stability: edge frequencies over subsamples of 80 %, their instability, and the walk down from the largest."""
    nets = lasso.subsampled(views.emb_long(spark, sf), [], subsamples)
    return r6(lasso.stable_penalty(lasso.instabilities(nets, subsamples=subsamples), []), "lambda")


def forest_importance(spark, sf, trees=forest.TREES):
    """Predictor → target importances of a forest for each target, above 1e-4, and of those the top 5 %."""
    return r6(network.top_share(forest.importances(views.emb_long(spark, sf), trees), "w"), "w")


def first_splits(spark, sf):
    """The best first split of every target."""
    return r6(forest.first_splits(views.emb_long(spark, sf)), "gain")


def factor_weights(spark, sf):
    """(sample_id, w1, w2, error): every sample's least-squares weights, not negative, on the rows of the two least samples, and the squared error left."""
    rows = matrix.arrays(matrix.shift_nonnegative(views.emb_long(spark, sf)))
    first = np.array([r["features"] for r in rows.orderBy("sample_id").limit(2).collect()], float)

    def run(batches):
        for ids, x in factor.tables(batches, first.shape[1]):
            w = factor.scores(x, first)
            yield pa.RecordBatch.from_arrays([ids, pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(((x - w @ first) ** 2).sum(axis=1))], ["sample_id", "w1", "w2", "error"])

    return r6(factor.blocks_of(rows).mapInArrow(run, "sample_id long, w1 double, w2 double, error double"), "w1", "w2", "error")


def consensus_classes(spark, sf):
    """Consensus between classes of samples with the same labels."""
    return r6(cohort.consensus_classes(views.runs(spark, sf)), "share")


QUERIES = {f.__name__: f for f in (knn_weights, fold_covariances, subsample_covariances, glasso_networks, glasso_edges, stars_lambda, forest_importance, first_splits, factor_weights, consensus_classes)}

_N = f"""{V['emb_long']}, m AS (SELECT *, CASE WHEN sample_id % 20 = 0 THEN 'small' WHEN sample_id % 20 <= 2 THEN 'middle' ELSE 'large' END AS grp FROM emb_long WHERE feature_id < 16)"""

ORACLE = {
    "knn_weights": f"""WITH RECURSIVE {V['emb_long']}, d AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM emb_long a JOIN emb_long b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id GROUP BY ALL),
      n AS MATERIALIZED (SELECT i, j, d FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 15),
      r AS MATERIALIZED (SELECT i, list(d ORDER BY d) AS ds, min(d) AS rho, avg(d) AS mean, (max(d) - min(d)) * 15 AS hi FROM n GROUP BY 1),
      b AS (SELECT i, ds, rho, mean, 0::DOUBLE AS lo, hi, 0 AS step FROM r
        UNION ALL SELECT i, ds, rho, mean, CASE WHEN above THEN lo ELSE mid END, CASE WHEN above THEN mid ELSE hi END, step + 1
        FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(ds, lambda x: exp((rho - x) / greatest((lo + hi) / 2, 1e-300)))) > log2(15) AS above FROM b WHERE step < 40)),
      s AS (SELECT i, rho, greatest(hi, 1e-3 * mean, 1e-300) AS scale FROM b WHERE step = 40),
      w AS (SELECT n.i, n.j, exp((rho - d) / scale) AS w FROM n JOIN s USING (i))
      SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, round(coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0), 6) AS w FROM w a FULL JOIN w b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.w, 0) + coalesce(b.w, 0) > 0""",
    "fold_covariances": f"""WITH {_N}, z AS (SELECT *, ('0x' || substr(md5(sample_id::VARCHAR), 1, 6))::INT % 5 AS fold, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z FROM m WINDOW w AS (PARTITION BY grp, feature_id))
      SELECT a.grp, f.set::INT AS set, a.feature_id AS i, b.feature_id AS j, round(covar_pop(a.z, b.z), 6) AS cov FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.feature_id <= b.feature_id JOIN (SELECT DISTINCT grp, fold AS set FROM z) f ON f.grp = a.grp AND f.set <> a.fold GROUP BY ALL""",
    "subsample_covariances": f"""WITH {_N}, s AS (SELECT grp, sample_id, s, substr(md5(sample_id || ':' || s), 1, 8) AS h FROM (SELECT DISTINCT grp, sample_id FROM m), range(20) t(s)),
      t AS (SELECT *, row_number() OVER (PARTITION BY grp, s ORDER BY h, sample_id) <= floor(0.8 * count(*) OVER (PARTITION BY grp, s)) AS taken FROM s),
      p AS (SELECT a.grp, s::INT AS set, a.feature_id AS i, b.feature_id AS j, covar_pop(a.value, b.value) AS c, stddev_pop(a.value) AS x, stddev_pop(b.value) AS y FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.feature_id <= b.feature_id JOIN t ON t.sample_id = a.sample_id AND taken GROUP BY ALL)
      SELECT grp, set, i, j, round(c / ((x + 1e-8) * (y + 1e-8)), 6) AS cov FROM p""",
    "first_splits": f"""WITH {V['emb_long']}, f AS (SELECT feature_id, min(value) AS low, max(value) AS high, avg(value) AS mean FROM emb_long GROUP BY 1),
      b AS (SELECT sample_id, feature_id, least(greatest(floor((value - low) / (high - low) * 32), 0), 31)::INT AS bin, value - mean AS y FROM emb_long JOIN f USING (feature_id)),
      h AS (SELECT t.feature_id AS target, x.feature_id AS feature, x.bin, count(*) AS w, sum(t.y) AS s FROM b t JOIN b x ON t.sample_id = x.sample_id AND t.feature_id <> x.feature_id GROUP BY ALL),
      c AS (SELECT target, feature, bin, sum(w) OVER (o ORDER BY bin) AS lw, sum(s) OVER (o ORDER BY bin) AS ls, sum(w) OVER o AS w, sum(s) OVER o AS s FROM h WINDOW o AS (PARTITION BY target, feature)),
      g AS (SELECT target, feature, bin, ls * ls / lw + (s - ls) * (s - ls) / (w - lw) - s * s / w AS gain FROM c WHERE lw < w)
      SELECT target, feature, bin, round(gain, 6) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY gain DESC, feature, bin) = 1""",
    "factor_weights": f"""WITH {V['emb_long']}, s AS (SELECT min(value) AS low FROM emb_long), x AS (SELECT sample_id, feature_id, CASE WHEN low < 0 THEN value - low + 0.01 ELSE value END AS v FROM emb_long, s),
      t AS (SELECT DISTINCT sample_id FROM x ORDER BY 1 LIMIT 2), a AS (SELECT feature_id, v FROM x WHERE sample_id = (SELECT min(sample_id) FROM t)), b AS (SELECT feature_id, v FROM x WHERE sample_id = (SELECT max(sample_id) FROM t)),
      g AS (SELECT sum(a.v * a.v) AS aa, sum(a.v * b.v) AS ab, sum(b.v * b.v) AS bb FROM a JOIN b USING (feature_id)),
      c AS (SELECT sample_id, sum(x.v * a.v) AS xa, sum(x.v * b.v) AS xb FROM x JOIN a USING (feature_id) JOIN b USING (feature_id) GROUP BY 1),
      z AS (SELECT *, (bb * xa - ab * xb) / (aa * bb - ab * ab) AS p, (aa * xb - ab * xa) / (aa * bb - ab * ab) AS q FROM c, g),
      w AS (SELECT sample_id, CASE WHEN p >= 0 AND q >= 0 THEN p WHEN greatest(xa, 0) ** 2 / aa >= greatest(xb, 0) ** 2 / bb THEN greatest(xa, 0) / aa ELSE 0 END AS w1,
        CASE WHEN p >= 0 AND q >= 0 THEN q WHEN greatest(xa, 0) ** 2 / aa >= greatest(xb, 0) ** 2 / bb THEN 0 ELSE greatest(xb, 0) / bb END AS w2 FROM z)
      SELECT sample_id, round(w1, 6) AS w1, round(w2, 6) AS w2, round(sum((x.v - w1 * a.v - w2 * b.v) ** 2), 6) AS error FROM w JOIN x USING (sample_id) JOIN a USING (feature_id) JOIN b USING (feature_id) GROUP BY sample_id, w1, w2""",
    "consensus_classes": f"""WITH {V['runs']}, s AS (SELECT sample_id, list(label ORDER BY run) AS l FROM runs GROUP BY 1), c AS (SELECT l, min(sample_id) AS class, count(*) AS size FROM s GROUP BY 1),
      r AS (SELECT class, size, unnest(l) AS label, unnest(range(len(l))) AS run FROM c)
      SELECT a.class AS a, b.class AS b, round(count(*) / 6.0, 6) AS share, any_value(a.size) AS size_a, any_value(b.size) AS size_b FROM r a JOIN r b ON a.run = b.run AND a.label = b.label AND a.class <= b.class GROUP BY 1, 2""",
}
