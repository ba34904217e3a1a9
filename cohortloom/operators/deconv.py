"""Cell-type deconvolution: reference profiles, non-negative least squares, profiles and marker purity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nonneg import nonnegative


def reference_profiles(cells: DataFrame) -> DataFrame:
    """(cell_type, gene_id, value): mean over the cells of a type."""
    return cells.groupBy("cell_type", "gene_id").agg(F.avg("value").alias("value"))


def proportions(bulk: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample_id, cell_type, proportion) summing to 1; an all-zero fit gives equal shares.

    bulk(sample_id, features array) and the reference share the gene order. The reference is a
    types × genes table (a few types, at most nonneg.MOST), sent along with the task; a batch of samples is solved at once.
    """
    rows = sorted(reference.collect(), key=lambda r: r["cell_type"])  # a few cell types
    types, a = [r["cell_type"] for r in rows], np.array([r["features"] for r in rows], float).T

    gram = a.T @ a
    names = pa.array(types)

    def run(batches):
        for b in batches:
            f = b.column("features")
            x = np.nan_to_num(f.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(b.num_rows, -1)
            w = nonnegative(gram, x @ a)
            total = w.sum(axis=1, keepdims=True)
            w = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / len(types))
            at = np.repeat(np.arange(b.num_rows), len(types))
            yield pa.RecordBatch.from_arrays([b.column("sample_id").take(pa.array(at)), names.take(pa.array(np.tile(np.arange(len(types)), b.num_rows))), pa.array(w.reshape(-1))], ["sample_id", "cell_type", "proportion"])

    kind = bulk.schema["sample_id"].dataType.simpleString()
    return bulk.select("sample_id", "features").mapInArrow(run, f"sample_id {kind}, cell_type string, proportion double")


def celltype_profiles(bulk: DataFrame, shares: DataFrame) -> DataFrame:
    """(sample_id, feature_id, cell_type, abundance): every value times the sample's share of each type."""
    return bulk.join(shares, "sample_id").select("sample_id", "feature_id", "cell_type", (F.col("value") * F.col("proportion")).alias("abundance"))


def marker_purity(profiles: DataFrame, markers: DataFrame) -> DataFrame:
    """(cell_type, n_markers, purity, status): own mean of a type's markers against the mean of the other types' means.

    Types none of whose markers occur are MISSING with purity 0; other types without the
    markers count as 0, and the others of a single type as 0.0001.
    """
    own = markers.withColumnRenamed("cell_type", "marker_of")
    types = profiles.select("cell_type").distinct()
    means = profiles.join(own, "feature_id").groupBy("marker_of", "cell_type").agg(F.avg("abundance").alias("m"), F.count_distinct("feature_id").alias("k"))
    grid = types.withColumnRenamed("cell_type", "marker_of").crossJoin(types).join(means, ["marker_of", "cell_type"], "left")
    is_own = F.col("cell_type") == F.col("marker_of")
    per = grid.groupBy("marker_of").agg(F.max(F.when(is_own, F.col("m"))).alias("own"), F.coalesce(F.max(F.when(is_own, F.col("k"))), F.lit(0)).alias("n_markers"), F.coalesce(F.avg(F.when(~is_own, F.coalesce("m", F.lit(0.0)))), F.lit(0.0001)).alias("others"))
    purity = F.when(F.col("n_markers") > 0, F.col("own") / (F.col("own") + F.col("others") + 1e-8)).otherwise(F.lit(0.0))
    status = F.when(F.col("n_markers") == 0, "MISSING").when(F.col("purity") > 0.6, "PASS").otherwise("LOW_CONFIDENCE")
    return per.withColumn("purity", purity).select(F.col("marker_of").alias("cell_type"), "n_markers", "purity", status.alias("status"))
