"""Reading and writing matrices, clinical tables and edges, and synthetic cohorts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "protein_a string, protein_b string, weight double, consensus_weight double, subtype string, cell_type string, layer string"


def is_transposed(n_rows: int, n_cols: int) -> bool:
    """A wide file whose rows outnumber its columns and pass a thousand has features as rows."""
    return n_rows > n_cols and n_rows > 1000


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, feature_id, value) of a wide CSV whose first column names the rows; NaN becomes NULL, features as rows are turned."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    first, *rest = wide.columns
    typed = wide.select(F.col(f"`{first}`").cast("string").alias("row"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    long = typed.unpivot(["row"], [f"`{c}`" for c in rest], "col", "value").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    names = ("feature_id", "sample_id") if is_transposed(wide.count(), len(rest)) else ("sample_id", "feature_id")
    return long.select(F.col("row").alias(names[0]), F.col("col").alias(names[1]), "value").select("sample_id", "feature_id", "value")


#: Names of the sample's column in older files.
SAMPLE_NAMES = ("projid", "patient_id", "sample_id", "individualID")


def with_sample_id(df: DataFrame, out: str = "sample_id") -> DataFrame:
    """The table with its sample's column, under whichever of SAMPLE_NAMES it comes, called `out`."""
    if out in df.columns:
        return df
    found = next((c for c in SAMPLE_NAMES if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(SAMPLE_NAMES)} among the columns")
    return df.withColumnRenamed(found, out)


def read_clinical_csv(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.csv(path, header=True, inferSchema=True)
    return wide.withColumnRenamed(wide.columns[0], "projid").withColumn("projid", F.col("projid").cast("string"))


def join_samples(m: DataFrame, clinical: DataFrame, key: str = "projid") -> DataFrame:
    """Inner join on the sample; an id that the clinical table repeats is an error, found by the same shuffle."""
    once = clinical.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in clinical.columns if c != key])
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string")))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    return m.join(once.withColumnRenamed(key, "sample_id"), "sample_id")


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _store(spark, path)
    return fs.exists(p)


def availability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, present) of the inputs of a study."""
    rows = [(n, p, exists(spark, p)) for n, p in sorted(paths.items())]
    return spark.createDataFrame(rows, "name string, path string, present boolean")


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet by way of a staging folder beside the path, so that a table may replace the one it was read from and a failed write leaves the old one, at the path or beside it."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(staging)
    old, fs = _store(spark, path)
    aside = _store(spark, f"{staging}-old")[0]
    fs.mkdirs(old.getParent())
    replaced = fs.exists(old)
    if replaced and not fs.rename(old, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(_store(spark, staging)[0], old):
        if replaced:
            fs.rename(aside, old)
        raise OSError(f"{staging} could not be moved to {path}")
    if replaced:
        fs.delete(aside, True)


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table after `change`, written over itself."""
    write_table(change(spark.read.parquet(path)), path)
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or one without rows where nothing is stored."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_matrix(m: DataFrame, path: str) -> None:
    write_table(m, path)


def write_edges(edges: DataFrame, path: str) -> None:
    """One table of all networks, a folder for each subtype, cell type and layer."""
    write_table(edges, path, ("subtype", "cell_type", "layer"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, EDGE_SCHEMA)


def networks(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(subtype, cell type) of the networks that a folder of edges holds, by the names of its folders."""
    root, fs = _store(spark, path)
    if not fs.exists(root):
        return []
    level = lambda p: [(s.getPath().getName().partition("=")[2], s.getPath()) for s in fs.listStatus(p) if "=" in s.getPath().getName()]
    return sorted((a, b) for a, p in level(root) for b, _ in level(p))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables, nodes and edges."""
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document over many lines, or one a line below the other."""
    return spark.read.option("multiLine", True).json(path)


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    """A text of a few lines as one file."""
    write_text = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
    write_text.write.mode("overwrite").text(path)


def synthetic_matrix(spark: SparkSession, n_samples: int = 100, n_features: int = 500, missing: float = 0.15, seed: int = 42) -> DataFrame:
    """Exponential values of scale 10, a share of them missing."""
    cells = spark.range(n_samples * n_features).select(F.format_string("patient_%03d", F.expr(f"id div {n_features}")).alias("sample_id"), F.format_string("PROT_%05d", F.col("id") % n_features).alias("feature_id"), "id")
    return cells.select("sample_id", "feature_id", F.when(F.rand(seed + 1) >= missing, -10 * F.ln(1 - F.rand(seed))).alias("value"))


def synthetic_clinical(spark: SparkSession, n_samples: int = 100, seed: int = 42) -> DataFrame:
    """Cases, controls with pathology (a quarter of the controls) and healthy controls."""
    r = lambda k: F.rand(seed + k)
    pick = lambda k, lo, hi: (F.lit(lo) + F.floor(r(k) * (hi - lo + 1))).cast("int")
    base = spark.range(n_samples).select(F.format_string("patient_%03d", "id").alias("projid"), F.when(r(0) < 0.45, "AD").otherwise("Control").alias("diagnosis"), (r(1) < 0.25).alias("asym"), pick(2, 60, 99).alias("age_death"), pick(3, 0, 1).alias("msex"), (2 + 28 * r(4)).alias("pmi"))
    case = F.col("diagnosis") == "AD"
    kind = lambda a, b, c: F.when(case, a).when(F.col("asym"), b).otherwise(c)
    return base.select("projid", "diagnosis", "age_death", "msex", "pmi", kind(pick(5, 4, 6), pick(5, 3, 6), pick(5, 0, 2)).alias("braaksc"), kind(pick(6, 3, 4), pick(6, 3, 4), pick(6, 1, 2)).alias("ceradsc"), kind(pick(7, 5, 24), pick(7, 26, 30), pick(7, 28, 30)).alias("mmse"), kind(pick(8, 2, 3), F.lit(1), F.lit(1)).alias("cogdx"))


def synthetic_cells(spark: SparkSession, n_cells: int = 1000, n_genes: int = 500, seed: int = 42) -> DataFrame:
    """(cell_id, cell_type, subject_id, gene_id, value >= 0) with a fixed mix of six cell types."""
    u = F.rand(seed)
    kind = F.when(u < 0.35, "Ex").when(u < 0.50, "In").when(u < 0.70, "Oli").when(u < 0.85, "Ast").when(u < 0.95, "OPCs").otherwise("Mic")
    cells = spark.range(n_cells).select(F.col("id").alias("cell_id"), kind.alias("cell_type"), (F.col("id") % 10).alias("subject_id"))
    genes = spark.range(n_genes).select(F.format_string("GENE_%05d", "id").alias("gene_id"))
    return cells.crossJoin(F.broadcast(genes)).withColumn("value", F.greatest(-0.5 * F.ln(1 - F.rand(seed + 1)) + F.randn(seed + 2), F.lit(0.0)))
