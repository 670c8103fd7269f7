"""Every registered query against its SQL, as sets of rows with the same types and values."""

import math
from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalog.oracle_sql():
        want = db.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        a, b = rows(df.columns, got), rows(names, want.fetchall())
        assert a == b, (len(got), sum(b.values()), list((a - b).items())[:3], list((b - a).items())[:3])
