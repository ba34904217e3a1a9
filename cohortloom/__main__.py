"""python -m cohortloom: runs a study from files, or from a synthetic cohort, and prints its log.

Exit status 0 if every step passed or was skipped, with or without a warning.
"""

from __future__ import annotations

import argparse
import sys


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("cohortloom", description=__doc__)
    p.add_argument("--data-dir", default="data", help="folder of matrix.csv, clinical.csv and, if there are any, cells.parquet, markers.parquet and known.parquet")
    p.add_argument("--results-dir", default="results", help="folder of the results' tables")
    p.add_argument("--test", action="store_true", help="a synthetic cohort of 50 patients and 200 proteins")
    p.add_argument("--skip-deconvolution", action="store_true", help="equal shares of the cell types")
    p.add_argument("--n-subtypes", type=int, help="as many subtypes, instead of the number chosen by cophenetic correlation")
    p.add_argument("--networks", action="store_true", help="the networks of every subtype and cell type, 2A to 2D")
    p.add_argument("--models", action="store_true", help="the networks, and the graph models of each, 3A, 3E and 3F")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import steps
    from .sources import io

    a = arguments(args)
    builder = SparkSession.builder.appName("cohortloom")
    # fifty patients need no more tasks
    spark = spark or (builder.config("spark.sql.shuffle.partitions", "4") if a.test else builder).getOrCreate()
    if a.test:
        m = io.synthetic_matrix(spark, 50, 200).withColumn("feature_id", F.regexp_replace("feature_id", "PROT", "GENE"))
        clinical, cells, markers, known = io.synthetic_clinical(spark, 50), io.synthetic_cells(spark, 1000, 200), None, None
    else:
        m, clinical = io.read_wide_csv(spark, f"{a.data_dir}/matrix.csv"), io.read_clinical_csv(spark, f"{a.data_dir}/clinical.csv")
        cells, markers, known = (spark.read.parquet(path) if io.exists(spark, path) else None for path in (f"{a.data_dir}/{n}.parquet" for n in ("cells", "markers", "known")))
    log = steps.study(spark, a.results_dir, m.persist(), clinical.persist(), None if a.skip_deconvolution else cells, markers, n_subtypes=a.n_subtypes, networks=a.networks, models=a.models, test=a.test, known=known)
    rows = log.orderBy("step").collect()
    for r in rows:
        print(f"{r['step']}  {r['status']:8s} {r['seconds']:8.1f} s  {r['error'] or ''}".rstrip())
    return int(any(r["status"] in ("FAIL", "NOT RUN") for r in rows))


if __name__ == "__main__":
    sys.exit(main())
