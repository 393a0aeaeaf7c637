"""Every query of the core catalogues against its SQL on DuckDB."""

import importlib

import pytest

import __spark_entry__
from tests.conftest import DATA

CATALOGUES = [importlib.import_module(name) for name in __spark_entry__.CATALOGUES]
QUERIES = {n: (f, m.ORACLE_SQL.get(n)) for m in CATALOGUES for n, f in m.QUERIES.items()}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
