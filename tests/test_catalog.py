"""Every query with SQL agrees with it on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def names():
    from kinfold.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, str):
            return v
        return round(float(v), 6) + 0.0

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", names() if os.path.isdir(SF) else [])
def test_query(spark, con, name):
    from kinfold.plans import catalog

    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert plain([r[c] for c in columns] for r in got.collect()) == plain([r[i] for i in order] for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
