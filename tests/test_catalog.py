"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark import catalog, catalog_assembly, catalog_binary, catalog_containers, catalog_more, catalog_records  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def in_order(rows):
    return sorted([tuple(plain(v) for v in r) for r in rows], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = in_order(df.select(*[f"`{n}`" for n in names]).collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    place = [[c[0] for c in result.description].index(n) for n in names]
    assert sorted(c[0] for c in result.description) == names
    assert found == in_order([[r[k] for k in place] for r in result.fetchall()])
    assert found or name in ()
