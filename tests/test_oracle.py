"""Every registered query of the engine's own operators against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

from graphloom.plans.oracle import ORACLE
from graphloom.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not SF.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, r)) for r in frame.astype(object).values.tolist())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        numbers = [c for c in got.columns if want[c].dtype.kind == "f" or got[c].dtype.kind == "f"]
        for f in (got, want):
            f[numbers] = f[numbers].astype(float)
        assert rows(got) == rows(want)
