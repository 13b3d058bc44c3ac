"""Every registered query of the library itself runs on small tables and gives the rows of its SQL."""

import math

import duckdb
import pytest

from demandlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, connection, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.ORACLES:
        picked = ", ".join(f'"{c}"' for c in columns)
        want = sorted(repr(tuple(map(plain, r))) for r in connection.execute(f"SELECT {picked} FROM ({registry.ORACLES[name]}) q").fetchall())
        assert got == want
