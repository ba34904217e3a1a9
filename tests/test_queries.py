"""Every query of the catalogue against DuckDB on the same files, and the shape of those without SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest

from cohortloom.catalogue import ORACLE, QUERIES

@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    run = duck.execute(ORACLE[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in run.fetchall())
    assert got


#: Fewer trees, subsamples and runs than registered, so that the tests end.
FEWER = {"forest_importance": {"trees": 4}, "stars_lambda": {"subsamples": 4}, **{n: {"ks": (2, 3), "runs": 2} for n in ("nmf_subtypes", "nmf_errors", "cophenetic", "select_k")}, "gat_train_eval": {"epochs": 2, "seeds": 2}, "integrated_gradients": {"epochs": 2, "seeds": 2, "steps": 5}, "baseline_mlp": {"steps": 20}, "baseline_gbt": {"trees": 5}, "baseline_gbt_mse": {"trees": 5}}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, sf, name):
    rows = QUERIES[name](spark, sf, **FEWER.get(name, {})).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(ORACLE) <= set(QUERIES) <= set(__spark_entry__.queries())
