"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from ledgerline.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)
    else:
        assert got
