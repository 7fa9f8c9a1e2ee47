"""Every query with SQL gives DuckDB's result on the same tables."""

import os

import duckdb
import pytest

import trialgrid.plans.comparison  # noqa: F401
import trialgrid.plans.composites  # noqa: F401
import trialgrid.plans.derived  # noqa: F401
import trialgrid.plans.neurometrics  # noqa: F401
import trialgrid.plans.phases  # noqa: F401
import trialgrid.plans.populations  # noqa: F401
import trialgrid.plans.regression  # noqa: F401
import trialgrid.plans.studies  # noqa: F401
import trialgrid.plans.transfer  # noqa: F401
from trialgrid.plans.registry import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else float(v) if hasattr(v, "as_integer_ratio") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    a = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
