"""Column types of every query equal those of its DuckDB twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_types_match(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(ORACLES[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    mismatched = {c: (t, duck_types.get(c)) for c, t in df.dtypes if SPARK_TO_DUCK.get(t, t) != duck_types.get(c)}
    assert mismatched == {}
