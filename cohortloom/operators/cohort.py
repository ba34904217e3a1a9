"""Patients: classes, stages, times, subtypes, and the joins that build the master table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from . import factor, stats

#: Names under which a clinical column may come; the first that exists wins.
VARIANTS = {"cogdx": ("cogdx", "COGDX"), "braaksc": ("braaksc", "BRAAKSC", "braak"), "ceradsc": ("ceradsc", "CERADSC", "cerad"), "mmse": ("mmse", "MMSE"), "age_death": ("age_death", "AGE_DEATH", "age")}


def resolve(df: DataFrame, name: str) -> str | None:
    return next((c for c in VARIANTS.get(name, (name,)) if c in df.columns), None)


def patient_class(df: DataFrame) -> Column:
    """Clinical AD if impaired; AsymAD if normal with braak and cerad of 3 or more; else Healthy Control. Without pathology, by diagnosis."""
    diag, cog, braak, cerad = "diagnosis", resolve(df, "cogdx"), resolve(df, "braaksc"), resolve(df, "ceradsc")
    by_diagnosis = F.when(F.col(diag) == "Control", "Healthy Control").otherwise("Clinical AD")
    if not (cog and braak and cerad):
        return by_diagnosis
    normal = F.coalesce(F.col(diag) == "Control", F.lit(False)) | F.coalesce(F.col(cog) == 1, F.lit(False))
    pathology = (F.col(braak) >= 3) & (F.col(cerad) >= 3)
    return F.when(F.col(braak).isNull() | F.col(cerad).isNull(), by_diagnosis).when(~normal, "Clinical AD").when(pathology, "AsymAD").otherwise("Healthy Control")


def classify_patients(df: DataFrame) -> DataFrame:
    return df.withColumn("patient_class", patient_class(df))


def disease_stage(dpt: Column) -> Column:
    return F.when(dpt < 0.33, "Early").when(dpt < 0.67, "Intermediate").otherwise("Advanced")


def event_flag(braak: Column, mmse: Column) -> Column:
    return F.coalesce(braak >= 4, F.lit(False)) | F.coalesce(mmse < 20, F.lit(False))


def in_order(df: DataFrame) -> DataFrame:
    """t: how many patients have a smaller id; ids that are not numbers are counted by prefix first, so that a window holds the ids of one prefix."""
    if isinstance(df.schema["projid"].dataType, NumericType):
        before = stats.running_sums(df.groupBy("projid").agg(F.count("*").alias("_n")), "projid", {"_t": F.col("_n")})
    else:
        counted = df.groupBy("projid").agg(F.count("*").alias("_n")).withColumn("_p", F.substring(F.col("projid").cast("string"), 1, 4))
        prefixes = counted.groupBy("_p").agg(F.sum("_n").alias("_m"))
        starts = prefixes.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_from"))  # one row a prefix
        own = Window.partitionBy("_p").orderBy("projid")
        before = counted.join(starts, "_p").withColumn("_t", F.col("_from") + F.sum("_n").over(own) - F.col("_n"))
    return df.join(before.select("projid", F.col("_t").cast("double").alias("t")), "projid")


def survival_inputs(df: DataFrame) -> DataFrame:
    """Adds t = (1 - dpt) * 100, the event flag and the stage; without pseudotime t is the row's place by id, and a measure that is absent marks no event."""
    absent = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    if "dpt" in df.columns:
        timed = df.withColumn("t", (1 - F.col("dpt")) * 100)
    else:
        timed = in_order(df)
    return timed.withColumn("event", event_flag(absent("braaksc"), absent("mmse"))).withColumn("stage", disease_stage(absent("dpt")))


def subtype_cohort(df: DataFrame) -> DataFrame:
    """The clinical cases: by patient class where that exists, else all that are not controls."""
    return df.where("patient_class = 'Clinical AD'") if "patient_class" in df.columns else df.where("diagnosis <> 'Control'")


def update_column(master: DataFrame, values: DataFrame, key: str, col: str) -> DataFrame:
    """The master table with `col` from `values`; rows without one have NULL."""
    return master.drop(col).join(values.select(key, col), key, "left")


def argmax(weights: DataFrame, row: str, idx: str, w: str) -> DataFrame:
    """The index of each row's greatest weight, the first on ties."""
    return weights.groupBy(row).agg(F.min_by(idx, F.struct(-F.col(w), F.col(idx))).alias(idx))


def root_cell(points: DataFrame, clinical: DataFrame) -> DataFrame:
    """The sample with cogdx 1 and braak of at most 1 that lies nearest to the mean point; the first sample if none does."""
    dims = [c for c in points.columns if c != "sample_id"]
    mean = points.agg(*[F.avg(d).alias(f"m_{d}") for d in dims])
    calm = clinical.where("cogdx = 1 and braaksc <= 1").select(F.col("projid").alias("sample_id"))
    d2 = sum(((F.col(d) - F.col(f"m_{d}")) ** 2 for d in dims), F.lit(0.0))
    near = points.join(calm, "sample_id", "left_semi").crossJoin(F.broadcast(mean)).agg(F.min_by("sample_id", F.struct(F.sqrt(d2), "sample_id")).alias("root"))
    first = points.agg(F.min("sample_id").alias("first_id"))
    return near.crossJoin(first).select(F.coalesce("root", "first_id").alias("root"))


def label_classes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, labels, size), (class, sample_id)) of runs(run, sample_id, label): samples of the same labels in all runs are one class, named by its least sample."""
    arrays = runs.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda x: x["label"].cast("int")).alias("labels"))
    return factor.classes(arrays, [])


def consensus_classes(runs: DataFrame) -> DataFrame:
    """(a, b, share, size_a, size_b) for classes a < b that ever agree, and for a = b (share n / (n + 1)): consensus with one row a pair of classes."""
    named, _ = label_classes(runs)
    named = named.persist()  # one row a class
    size = named.select("class", "size")
    shares = factor.class_shares(named, [], extra=1)
    return shares.join(size.select(F.col("class").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("class").alias("b"), F.col("size").alias("size_b")), "b").select("a", "b", "share", "size_a", "size_b")


#: Samples of a class that are expanded together, about.
BLOCK = 8_192


#: Rows of a batch of expanded pairs, about.
PAIRS = 1 << 16


def expanded(batches):
    """(i, j, share), i < j, of pairs of blocks of whole-number ids; two blocks that are the same one give each pair once."""
    for t in batches:
        for xs, ys, share, same in zip(t.column("xs"), t.column("ys"), t.column("share").to_pylist(), t.column("same").to_pylist()):
            x, y = xs.values.to_numpy(), ys.values.to_numpy()
            step = max(1, PAIRS // len(y))
            for k in range(0, len(x), step):
                i, j = np.repeat(x[k : k + step], len(y)), np.tile(y, len(x[k : k + step]))
                if same:
                    i, j = i[i < j], j[i < j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(np.full(len(i), share))], ["i", "j", "share"])


def consensus_matrix(runs: DataFrame, digits: int | None = None) -> DataFrame:
    """(i, j, share) for i < j: in which share of all runs plus one two samples have one label, as the base run counts once more.

    Classes of equal labels, expanded to their samples; pairs that never agree are absent (share 0). Shares are rounded
    to `digits` once a pair of classes. Classes are packed into blocks, pairs of blocks are dealt over the tasks, and only
    there become rows, so that what is shuffled is small beside the result and no task holds more than two blocks at once.
    """
    pairs, (_, members) = consensus_classes(runs), label_classes(runs)
    if digits is not None:
        pairs = pairs.withColumn("share", F.round("share", digits))
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("n"))
    blocks = members.join(sizes, "class").groupBy("class", F.expr("pmod(xxhash64(sample_id), n)").alias("k")).agg(F.collect_list("sample_id").alias("ids"))
    met = pairs.select("a", "b", "share").join(blocks.toDF("a", "p", "xs"), "a").join(blocks.toDF("b", "q", "ys"), "b").where("a < b or p <= q")
    spark = runs.sparkSession
    dealt = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "a", "p", "b", "q")
    if isinstance(runs.schema["sample_id"].dataType, IntegralType):
        kind = runs.schema["sample_id"].dataType.simpleString()
        return dealt.select("xs", "ys", "share", F.expr("a = b and p = q").alias("same")).mapInArrow(expanded, f"i {kind}, j {kind}, share double")
    each = dealt.withColumn("x", F.explode("xs")).drop("xs").withColumn("y", F.explode("ys")).where("a < b or p < q or x < y")
    return each.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "share")


def select_k(candidates: DataFrame, min_cophenetic: float = 0.85, min_size: int = 10) -> DataFrame:
    """The k of the greatest cophenetic correlation among those above the bound with clusters of the size asked; else 2."""
    good = candidates.where((F.col("cophenetic") > min_cophenetic) & (F.col("min_cluster") >= min_size))
    return good.agg(F.coalesce(F.max_by("k", F.struct("cophenetic", -F.col("k"))), F.lit(2)).alias("k"))


def name_subtypes(df: DataFrame) -> DataFrame:
    """(subtype, name): dominant cell type by mean proportion and stage by mean pseudotime, as "Ex-enriched (Early)".

    Rows without a subtype are left out; without cell-type columns, or without pseudotime, that part is "Unknown".
    """
    cts = [c for c in df.columns if c.startswith("ct_")]
    has_time = "dpt" in df.columns
    mean = df.where(F.col("subtype").isNotNull()).groupBy("subtype").agg(*[F.avg(c).alias(c) for c in cts], *[F.avg("dpt").alias("dpt")] * has_time, F.count("*").alias("n"))
    best = F.greatest(*cts) if len(cts) > 1 else F.col(cts[0]) if cts else None
    top = F.coalesce(*[F.when(F.col(c) == best, F.lit(c[3:])) for c in cts], F.lit("Unknown"))
    stage = disease_stage(F.col("dpt")) if has_time else F.lit("Unknown")
    return mean.select("subtype", F.concat(top, F.lit("-enriched ("), stage, F.lit(")")).alias("name"))


def running_lambda(path: DataFrame, beta: float = 0.05) -> DataFrame:
    """The smallest lambda before the first whose instability exceeds beta, walking down from the largest; the largest if that exceeds."""
    w = Window.orderBy(F.desc("lambda"))  # a handful of penalties
    walked = path.withColumn("broken", F.max((F.col("instability") > beta).cast("int")).over(w))
    return walked.agg(F.coalesce(F.min(F.when(F.col("broken") == 0, F.col("lambda"))), F.max("lambda")).alias("lambda"))


def with_controls(subtype: DataFrame, master: DataFrame) -> DataFrame:
    """The rows of one subtype and all controls below; a control of the subtype occurs twice."""
    return subtype.unionByName(master.where("diagnosis = 'Control'").select(*subtype.columns))
