"""Every registered query against its SQL twin in another engine."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract
from seclake.plans import oracle, registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(repr(plain(row[i])) for i in order) for row in rows)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(oracle.all_sql())
    assert set(registry.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cursor = duck.execute(oracle.all_sql()[name])
    expected = table([c[0] for c in cursor.description], cursor.fetchall())
    assert table(df.columns, df.collect()) == expected
