"""Each registered query gives the rows its SQL gives, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from shelfwise import catalog
from tests.conftest import SMALL
from tools.check import TABLES, canonical, same_kind

QUERIES = catalog.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(catalog.oracle_sql())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert all(same_kind(k, kinds[c]) for c, k in df.dtypes)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
