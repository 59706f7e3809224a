"""Every registered query with SQL gives DuckDB's rows on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from litgrid.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    same = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(same(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cur = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
