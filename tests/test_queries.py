"""Every registered query against its SQL on the correctness tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from kantele import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
METHODS = sorted(queries.QUERIES)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def oracle():
    made = {}

    def connect(folder):
        if folder not in made:
            made[folder] = duckdb.connect()
            for t in TABLES:
                made[folder].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return made[folder]

    return connect


@pytest.mark.parametrize("name", METHODS)
def test_query(spark, oracle, name):
    folder = "/root/testdata/sf0.01"
    df = queries.QUERIES[name](spark, folder)
    found = rows(df.columns, df.collect())
    assert found
    if name not in queries.ORACLE_SQL:
        return
    answer = oracle(folder).execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    expected = rows(names, answer.fetchall())
    assert sorted(df.columns) == sorted(names) and len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9), (a, b)


def test_train_rmcm_past_ten_million_edges(spark, oracle, tmp_path):
    """Copies of all rows leave the units where they are; 20 of them have 400 times the edges."""
    folder = "/root/testdata/sf0.01"
    edges = oracle(folder).execute(f"with p as ({queries.CUSTOMERS}), e as ({queries.EDGES}) select count(*) from e").fetchall()[0][0]
    assert 400 * edges > 10_000_000
    copies = "select c.* replace (c_custkey + 1000000 * k as c_custkey) from customer c, range(20) r(k)"
    oracle(folder).execute(f"copy ({copies}) to '{tmp_path}/customer.parquet' (format parquet)")
    df = queries.train_rmcm(spark, str(tmp_path))
    expected = oracle(folder).execute(queries.ORACLE_SQL["train_rmcm"]).fetchall()
    found, expected = rows(df.columns, df.collect()), rows(["unit", "c0", "c1", "n_iter"], expected)
    assert len(found) == len(expected) == 4
    for a, b in zip(found, expected, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
