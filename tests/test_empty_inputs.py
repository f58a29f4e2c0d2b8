"""Every registered query runs on empty copies of all driver tables (an
empty load batch, an empty landing, an empty stream) without failing."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL, TABLES

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty-sf"))
    for t in TABLES:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.count() >= 0
