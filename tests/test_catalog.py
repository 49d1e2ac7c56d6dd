"""Every registered query against its SQL twin on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tests.conftest import SMALL
from tideboard import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_twins_belong_to_queries():
    assert set(catalog.twins()) <= set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    twin = catalog.twins().get(name)
    if twin is None:
        assert got
        return
    cursor = duck.execute(twin)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(float(r[i]) if hasattr(r[i], "as_tuple") else r[i] for i in order) for r in cursor.fetchall())
    assert got == want
