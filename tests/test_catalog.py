"""Every registered time-series query: against its oracle where SQL can say it, else for its rows."""

import pytest

from conftest import DATA
from tidemark import catalog


def plain(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
