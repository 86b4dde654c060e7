"""Every registered query against its SQL on the smallest tables."""

import pytest

from check import table_of
from tallyfold.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLES[name])
    assert got == table_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
