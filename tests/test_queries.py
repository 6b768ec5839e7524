"""Every query with SQL gives DuckDB's rows on the small tables."""

import glob
import os

import duckdb
import pytest

from tidewright.plans.registry import PAIRS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query(name, spark, duck):
    run, sql = PAIRS[name]
    df = run(spark, SF)
    want = duck.execute(sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
