"""Every query with SQL gives the same rows in DuckDB, and every other one gives rows."""

import math

import duckdb
import pytest

from emberline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(rows):
    one = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted("|".join(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(cols).collect())
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert got == normal(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    else:
        assert got
