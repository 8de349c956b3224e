"""Every query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from terrane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}.parquet") else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return "" if v is None else v


def _rows(rows):
    return sorted(tuple(map(_cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    have, want = _rows(tuple(r[c] for c in columns) for r in got.collect()), _rows(want)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(abs(x - y) <= 2e-5 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
