"""From raw documents to token counts: five stages over the text operators.

quality: documents that the classifier rejects go (fitted on the labels of `sf_dir`).
near_dedup: of each group of near-duplicates the document of the smallest id stays.
decontaminate: documents that hold a window of a benchmark item go.
secrets: found secrets are replaced by a mark; n_chars follows the text.
tokens: each document's byte-level BPE ids, as their number and digests.

Edge cases: a null or empty text is scored by the classifier's bias, has no words, windows or
secrets and gives no ids; of all such texts that the classifier keeps one stays. Rows of a repeated id
are copies of one document and leave one row; rows without an id stay, and remove nothing. Columns besides
those of documents stay until the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, near_dedup, quality, secrets
from cohortloom.llm.common import free_name, shared_folder, table

#: Stages are tested against brute force; no SQL has the classifier or the merges.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    own = free_name(docs, "score")
    return quality.score(docs, model, out_col=own).where(F.col(own) >= quality.KEEP).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, *bpe.default_vocab())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one),
    ("decontaminate", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn; each result is written as Parquet to the shared folder and read again, and goes once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
