"""The engine's input tables drawn from the star schema: long matrices, a clinical table, cells, survival times and label runs.

A matrix is long, (sample_id, feature_id, value), and a missing value is NULL or an absent row, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense signed matrix; feature ids count from 0."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value")).withColumn("value", F.col("value").cast("double"))


def _spend(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("feature_id"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("sample_id"), "feature_id").agg(F.sum("l_extendedprice").alias("value"))


def spend_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer × part type; some cells are absent."""
    return _spend(spark, sf_dir, "p_type")


def spend_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer × brand; about a quarter of the cells are absent."""
    return _spend(spark, sf_dir, "p_brand")


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer as a patient; the clinical columns follow from the key and have NULLs."""
    k = "c_custkey"
    return read(spark, sf_dir, "customer").selectExpr(
        f"{k} as projid",
        f"case when {k} % 20 < 9 then 'AD' else 'Control' end as diagnosis",
        f"60 + ({k} * 13) % 40 as age_death",
        f"{k} % 2 as msex",
        f"2 + cast(({k} * 11) % 280 as double) / 10 as pmi",
        f"case when {k} % 17 = 0 then null else {k} % 7 end as braaksc",
        f"case when {k} % 19 = 0 then null else {k} % 4 + 1 end as ceradsc",
        f"case when {k} % 23 = 0 then null else 5 + ({k} * 7) % 26 end as mmse",
        f"case when {k} % 29 = 0 then null else {k} % 3 + 1 end as cogdx",
        f"cast(({k} * 37) % 1000 as double) / 1000 as dpt",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single cells, long: lines as cells, part types as cell types, four numbers as genes."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    wide = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_id"), F.col("p_type").alias("cell_type"), "l_quantity", F.col("l_extendedprice").alias("l_price"), "l_discount", "l_tax")
    return wide.unpivot(["cell_id", "cell_type"], ["l_quantity", "l_price", "l_discount", "l_tax"], "gene_id", "value")


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, t, event) from the event stream."""
    return read(spark, sf_dir, "events").select(F.col("event_id"), (F.col("user_id") % 3).alias("grp"), F.floor("value").cast("long").alias("t"), F.col("event_type").isin("error", "purchase").cast("int").alias("event"))


def runs(spark: SparkSession, sf_dir: str, n_runs: int = 5) -> DataFrame:
    """(run, sample_id, label): clusterings of the samples."""
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"))
    r = spark.range(n_runs).withColumnRenamed("id", "run")
    return ids.crossJoin(F.broadcast(r)).select("run", "sample_id", F.expr("(sample_id * (run + 3) div 7) % 4").alias("label"))


#: The same tables for DuckDB, as the heads of WITH lists.
SQL = {
    "emb_long": "emb_long AS (SELECT vec_id AS sample_id, unnest(range(len(embedding)))::INT AS feature_id, unnest(embedding)::DOUBLE AS value FROM embeddings)",
    "spend_type": "spend_type AS (SELECT o_custkey AS sample_id, p_type AS feature_id, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "spend_brand": "spend_brand AS (SELECT o_custkey AS sample_id, p_brand AS feature_id, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "clinical": """clinical AS (SELECT c_custkey AS projid, CASE WHEN c_custkey % 20 < 9 THEN 'AD' ELSE 'Control' END AS diagnosis,
      60 + (c_custkey * 13) % 40 AS age_death, c_custkey % 2 AS msex, 2 + ((c_custkey * 11) % 280)::DOUBLE / 10 AS pmi,
      CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 7 END AS braaksc, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 4 + 1 END AS ceradsc,
      CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 5 + (c_custkey * 7) % 26 END AS mmse, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 3 + 1 END AS cogdx,
      ((c_custkey * 37) % 1000)::DOUBLE / 1000 AS dpt FROM customer)""",
    "cells": """cells AS (SELECT l_orderkey || '-' || l_linenumber AS cell_id, p_type AS cell_type, u.gene_id, u.value
      FROM lineitem JOIN part ON l_partkey = p_partkey, LATERAL (VALUES ('l_quantity', l_quantity), ('l_price', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) u(gene_id, value))""",
    "survival": "survival AS (SELECT event_id, user_id % 3 AS grp, floor(value)::BIGINT AS t, (event_type IN ('error', 'purchase'))::INT AS event FROM events)",
    "runs": "runs AS (SELECT r.run, vec_id AS sample_id, ((vec_id * (r.run + 3)) // 7) % 4 AS label FROM embeddings, (SELECT unnest(range(5)) AS run) r)",
}
