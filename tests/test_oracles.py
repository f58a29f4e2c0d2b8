"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import canonical
from tests.conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_every_query_has_an_oracle_or_is_listed():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 140


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["d", "clicks", "big_purchases", "big_purchase_value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows is not None
        return
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    expected = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(expected)
    assert canonical(df.columns, rows) == canonical(cols, expected)
