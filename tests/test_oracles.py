"""Every query with SQL gives the rows that DuckDB gives for it; the others run and keep their schema."""

import os
import re

import duckdb
import pytest

from weblens import queries as core

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if isinstance(x, (int, float, str, bool)) else str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = ordered(map(tuple, got.select(*columns).collect())), ordered(want.select(*columns).fetchall())
    assert len(a) == len(b) and a == b
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    for column, kind in got.dtypes:
        of = kinds[column]
        assert {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(re.sub(r"\W.*", "", kind), of) == of, (column, kind, of)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    got = core.queries()[name](spark, SF)
    assert got.columns and got.count() >= 0
