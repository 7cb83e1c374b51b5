"""Every registered query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(records):
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert names == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS.get(k) for c, k in got.dtypes} == kinds
    quoted = ", ".join(f'"{n}"' for n in names)
    assert rows(got.select(*names).collect()) == rows(want.project(quoted).fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
