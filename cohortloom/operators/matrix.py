"""Operators on long matrices (sample_id, feature_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import nearest_donors

KEYS = ["sample_id", "feature_id"]


def complete_grid(m: DataFrame) -> DataFrame:
    """Every sample × feature cell; absent cells as NULL. The feature list is the short side and is what Spark may broadcast."""
    grid = m.select("sample_id").distinct().crossJoin(m.select("feature_id").distinct())
    return grid.join(m, KEYS, "left")


def missing_pct(m: DataFrame) -> DataFrame:
    """Percentage of samples without a value, per feature; needs one aggregate and the number of samples, not the grid."""
    n = m.agg(F.count_distinct("sample_id").alias("n"))
    held = m.groupBy("feature_id").agg(F.count(F.nanvl("value", F.lit(None))).alias("held"))
    return held.crossJoin(F.broadcast(n)).select("feature_id", ((F.col("n") - F.col("held")) * 100.0 / F.col("n")).alias("missing_pct"))


def qc_filter(m: DataFrame, max_missing_pct: float = 50.0) -> DataFrame:
    """Cells of the features that miss at most so many percent (inclusive)."""
    return m.join(missing_pct(m).where(F.col("missing_pct") <= max_missing_pct), "feature_id", "left_semi").select(*KEYS, "value")


def log2_transform(m: DataFrame, offset: float = 1.0) -> DataFrame:
    return m.withColumn("value", F.log2(F.col("value") + offset))


def zscore(m: DataFrame) -> DataFrame:
    """Per feature, population deviation; a constant feature is only centred."""
    stats = m.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return m.join(stats, "feature_id").select(*KEYS, ((F.col("value") - F.col("mean")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))).alias("value"))


def mean_fill(m: DataFrame) -> DataFrame:
    """The complete grid with missing cells at the feature's mean."""
    means = m.groupBy("feature_id").agg(F.avg("value").alias("mean"))
    return complete_grid(m).join(means, "feature_id").select(*KEYS, F.coalesce("value", "mean").alias("value"))


def shift_nonnegative(m: DataFrame) -> DataFrame:
    """value - min + 0.01 if any value is negative, by the minimum of the whole matrix."""
    low = m.agg(F.min("value").alias("low"))
    return m.crossJoin(F.broadcast(low)).select(*KEYS, F.when(F.col("low") < 0, F.col("value") - F.col("low") + 0.01).otherwise(F.col("value")).alias("value"))


def residualise(m: DataFrame, covariates: DataFrame, names: list[str], id_col: str = "sample_id") -> DataFrame:
    """Residuals of each feature's least squares on the covariates, with intercept.

    Covariates that are NULL stand at their mean; absent ones are skipped. Each feature's normal equations are sums
    over its rows (one aggregate with partial sums); their solution, a row a feature, is joined back.
    """
    names = [n for n in names if n in covariates.columns]
    k = len(names)
    means = covariates.agg(*[F.avg(n).alias(f"_m_{n}") for n in names], F.lit(0).alias("_"))
    # centred, so that the sums stay small
    filled = covariates.crossJoin(F.broadcast(means)).select(F.col(id_col).alias("sample_id"), *[(F.coalesce(F.col(n).cast("double"), F.col(f"_m_{n}")) - F.col(f"_m_{n}")).alias(f"_x{i}") for i, n in enumerate(names)])
    x = (m.join(filled, "sample_id") if k else m).where(F.col("value").isNotNull())
    cols = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k)]]
    sums = x.groupBy("feature_id").agg(F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("xx"), F.array(*[F.sum(a * F.col("value")) for a in cols]).alias("xy"))

    def solve(parts):
        for p in parts:
            xx = np.array(p["xx"].tolist(), float).reshape(-1, k + 1, k + 1)
            beta = np.einsum("fij,fj->fi", np.linalg.pinv(xx, rcond=1e-11, hermitian=True), np.array(p["xy"].tolist(), float).reshape(-1, k + 1))
            yield pd.DataFrame({"feature_id": p["feature_id"], "beta": list(beta)})

    fits = sums.mapInPandas(solve, f"feature_id {m.schema['feature_id'].dataType.simpleString()}, beta array<double>")
    fitted = sum((F.col("beta")[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    return x.join(fits, "feature_id").select(*KEYS, (F.col("value") - fitted).alias("value"))


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes from 0 in the order of the distinct values, -1 for NULL; the values (few) are ranked apart from the rows."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(values, col, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def top_variable(m: DataFrame, n: int) -> DataFrame:
    """(feature_id, variance, rank) of the features of the greatest sample variance; ties by feature id."""
    var = m.groupBy("feature_id").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "feature_id").limit(n)
    return var.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "feature_id")))


def knn_impute(m: DataFrame, k: int = 5) -> DataFrame:
    """Missing cells of the grid from the k nearest samples that have the feature, by inverse distance.

    Distance over the features both have, scaled up to all features. A donor at distance
    zero takes all the weight; without donors the cell is the feature's mean. Only
    samples that miss something are compared with others.
    """
    m = m.persist()  # read for its columns, the grid and the means
    names = m.select("feature_id").distinct().select(F.array_sort(F.collect_list("feature_id")).alias("names"))
    rows = arrays(complete_grid(m)).persist()  # packed twice and counted; computed again if an executor is lost
    short = rows.where(F.exists("features", lambda v: v.isNull()))
    near = nearest_donors(short, rows, k).groupBy("sample_id", "place").agg(F.avg(F.when(F.col("d") == 0, F.col("value"))).alias("same"), (F.sum(F.when(F.col("d") > 0, F.col("value") / F.col("d"))) / F.sum(F.when(F.col("d") > 0, 1 / F.col("d")))).alias("weighted"))
    missing = short.select("sample_id", F.posexplode("features").alias("place", "v")).where("v is null").drop("v")
    means = m.groupBy("feature_id").agg(F.avg("value").alias("mean"))
    named = missing.join(near, ["sample_id", "place"], "left").crossJoin(F.broadcast(names)).withColumn("feature_id", F.element_at("names", F.col("place") + 1))
    return named.join(means, "feature_id").select(*KEYS, F.coalesce("same", "weighted", "mean").alias("value"))


def head_samples(m: DataFrame, n: int) -> DataFrame:
    """The cells of the first n samples by id."""
    return m.join(F.broadcast(m.select("sample_id").distinct().orderBy("sample_id").limit(n)), "sample_id", "left_semi").select(*KEYS, "value")


def first_features(m: DataFrame, n: int) -> DataFrame:
    """The cells of the first n features by id."""
    return m.join(F.broadcast(m.select("feature_id").distinct().orderBy("feature_id").limit(n)), "feature_id", "left_semi").select(*KEYS, "value")


def prefilter(m: DataFrame, most: int = 500) -> DataFrame:
    """The matrix as it is if it has at most so many features, else those of the greatest variance."""
    if m.select("feature_id").distinct().limit(most + 1).count() <= most:
        return m
    return m.join(F.broadcast(top_variable(m, most).select("feature_id")), "feature_id", "left_semi").select(*KEYS, "value")


def prefilter_by(m: DataFrame, most: int = 500) -> DataFrame:
    """prefilter for a matrix with further columns, which stay; the variance is that of all its cells."""
    few = prefilter(m, most)
    return m if few is m else m.join(few.select("feature_id").distinct(), "feature_id", "left_semi").select(m.columns)


def pivot(m: DataFrame, features: list) -> DataFrame:
    """One row per sample and one column per listed feature; a repeated cell is an error."""
    once = m.groupBy("sample_id").pivot("feature_id", features)
    return once.agg(F.when(F.count("value") > 1, F.raise_error(F.lit("repeated cell"))).otherwise(F.max("value")))


def unpivot(wide: DataFrame, id_col: str = "sample_id") -> DataFrame:
    names = [c for c in wide.columns if c != id_col]
    return wide.unpivot([id_col], names, "feature_id", "value")


def arrays(m: DataFrame) -> DataFrame:
    """(sample_id, features array) ordered by feature id; the form that numeric kernels take."""
    return m.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "value"))), lambda s: s["value"]).alias("features"))


def principal_components(m: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """((sample_id, scores array) of the centred matrix, shares of the variance); each axis points where its greatest loading is positive."""
    wide = m.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "value"))), lambda s: s["value"]).alias("features")).select("sample_id", array_to_vector("features").alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(wide).transform(wide)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    turned = F.zip_with(vector_to_array("p"), F.array(*[F.lit(float(x)) for x in sign]), lambda a, b: a * b)
    return model.transform(centred).select("sample_id", turned.alias("scores")), [float(x) for x in model.explainedVariance]


def histogram(df: DataFrame, col: str, bins: int, group: str | None = None) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last closed: bin, n, density."""
    keys = [group] if group else []
    known = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("v"))
    bounds = known.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    joined = known.join(bounds, keys) if keys else known.crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    return joined.withColumn("bin", at.cast("int")).withColumn("w", width).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("w").alias("w"), F.first("total").alias("total")).select(*keys, "bin", "n", (F.col("n") / F.nullif(F.col("total") * F.col("w"), F.lit(0.0))).alias("density"))
