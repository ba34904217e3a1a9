"""Helpers shared by the text operators: tables, splits, checkpoints, components."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most 200 rows and about 2 MB, so that Python workers stay small next to the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % m


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers compressed byte plane by byte plane."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def portions(texts: list, size: int = 1 << 20):
    """The texts in turn, in lists of about `size` characters (a longer text is a list of its own), to bound what a task holds at once."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def within_bytes(df: DataFrame, id_col: str, size: Column, most: int) -> DataFrame:
    """The rows, checkpointed; if their sizes pass `most` together, the share of them, chosen by a hash of the id, that keeps near it."""
    held = checkpoint(df)
    total = held.agg(F.sum(size.cast("long"))).first()[0] or 0
    return held if total <= most else held.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 20)) < most / total * (1 << 20))


def trim() -> None:
    """Gives what this worker has freed back to the system: workers stay for the next stage, beside the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """The function of a task over batches, which trims its worker at the end."""

    def work(batches):
        yield from run(batches)
        trim()

    return work


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where that is unset, a private one on a local master only (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def parts(spark: SparkSession, least: int) -> int:
    """Partitions of a shuffle: the session's number, or more where the data ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges(a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as joins on
    pre-aggregated minima, each round checkpointed. No star is ever gathered into one
    group: the minimum of a node's neighbours is a partial aggregate, and the join that
    hands it back can be split by adaptive execution when a node has many neighbours.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:  # every round that changes anything lowers a neighbour, so this ends
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u point at the least of u's neighbourhood
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours point at the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
