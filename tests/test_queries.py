"""Every registered query with SQL against that SQL, and the others for rows."""

import math

import duckdb
import pytest

from corvane.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.7g}")
    return x


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, oracle, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    found = oracle.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    named = ", ".join(f'"{c}"' for c in columns)
    expected = oracle.sql(f"select {named} from ({ORACLES[name]}) q").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in expected), key=str)
