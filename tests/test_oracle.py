"""Every query with SQL gives the rows that DuckDB gives."""

import os
import re

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in sorted(__spark_entry__.oracle_sql()) if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, con, sf, name):
    df = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(str(plain(r[c])) for c in cols) for r in df.collect()))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(plain(r[names.index(c)])) for c in cols) for r in found.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).schema.names == ["id", "name", "amount_usd", "latest_round_id", "latest_amount"]
