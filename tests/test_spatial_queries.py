"""Every deterministic query gives the rows of its SQL."""

import duckdb
import pytest

from lagweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, other = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    by = [c for c in columns if mine[c].dtype.kind != "f"] or columns
    by += [c for c in columns if c not in by]
    a, b = (df[columns].sort_values(by).reset_index(drop=True) for df in (mine, other))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs() < 2e-4).all() or a[c].equals(b[c]), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_entry_has_rows():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
