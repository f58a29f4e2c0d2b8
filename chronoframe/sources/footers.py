"""Counts and extremes of Parquet tables from file footers.

Spark's second-generation Parquet source answers ``count``, ``min`` and ``max``
from the statistics in the footers, without reading a row group, for booleans,
whole numbers, floating numbers and dates. Both settings that this takes are
set while the one-row aggregate runs and put back after it. For other types
(timestamps, text, decimals) Spark scans the pruned column as usual.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOOTER_TYPES = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date")
_SOURCES = "spark.sql.sources.useV1SourceList"
_PUSH = "spark.sql.parquet.aggregatePushdown"


@contextmanager
def footer_aggregates(spark: SparkSession) -> Iterator[None]:
    """Aggregates that are planned and run inside use footers where types allow it."""
    old = {k: spark.conf.get(k) for k in (_SOURCES, _PUSH)}
    spark.conf.set(_SOURCES, ",".join(s for s in old[_SOURCES].split(",") if s.strip() != "parquet"))
    spark.conf.set(_PUSH, "true")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: ``count`` and, for each column, ``min_<column>`` and ``max_<column>``.
    Runs at once, inside the settings; the row is the result. An empty table
    counts 0 and has NULL extremes. Columns of other types are scanned by an
    aggregate of their own, so that they do not keep the rest from the footers."""
    with footer_aggregates(spark):
        kinds = dict(spark.read.parquet(path).dtypes)
        quick = footer_query(spark, path, [c for c in columns if kinds[c] in FOOTER_TYPES])
        got = quick.collect()[0].asDict()
        got["count"] = got["count"] or 0  # files without a row group have no footer count to add up
        fields = {f.name: f for f in quick.schema}
        rest = [c for c in columns if kinds[c] not in FOOTER_TYPES]
        if rest:
            scanned = footer_query(spark, path, rest).drop("count")
            got.update(scanned.collect()[0].asDict())
            fields.update({f.name: f for f in scanned.schema})
    names = ["count", *[f"{n}_{c}" for c in columns for n in ("min", "max")]]
    return spark.createDataFrame([tuple(got[n] for n in names)], StructType([fields[n] for n in names]))


def footer_query(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The aggregate of ``footer_stats``, to be planned inside ``footer_aggregates``."""
    extremes = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("count"), *extremes)
