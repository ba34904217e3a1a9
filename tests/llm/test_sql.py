"""The text queries that have SQL, against DuckDB on the same files."""

import os
from collections import Counter

import duckdb
import pytest

from cohortloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    run = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert Counter(tuple(r[x] for x in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in run.fetchall())
