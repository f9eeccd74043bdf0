"""Every query with an oracle equals it; tests use the smallest tables."""

import math

import duckdb
import pytest

from versight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
