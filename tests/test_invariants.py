"""Invariants that tie operators together on the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoframe.operators import loads, series
from chronoframe.plans.common import running_qty, table
from tests.conftest import SF_SMALL

Q = entry.queries()


def test_date_merge_preserves_totals(spark):
    merged = Q["J03_date_merge_fill"](spark, SF_SMALL)
    total = merged.select(sum(F.col(c) for c in ["click", "view", "purchase", "error"]).alias("t")).agg(F.sum("t")).first()[0]
    expected = table(spark, SF_SMALL, "events").filter(F.col("event_type").isin("click", "view", "purchase", "error")).count()
    assert total == expected


def test_pivot_columns_sum_to_bucket_counts(spark):
    wide = Q["R01_pivot_sum"](spark, SF_SMALL).select("month", (F.col("F") + F.col("O") + F.col("P")).alias("n"))
    long = Q["A06_bucket_count_month"](spark, SF_SMALL).groupBy("month").agg(F.sum("count").alias("n"))
    assert wide.exceptAll(long).count() == 0 and long.exceptAll(wide).count() == 0


def test_diff_recovers_daily_values(spark):
    d = Q["W01_diff_lag1"](spark, SF_SMALL)
    r = running_qty(spark, SF_SMALL, by_flag=True)
    j = d.join(r.select("l_returnflag", "sd", "qty"), ["l_returnflag", "sd"])
    assert j.filter(F.col("total_diff") != F.col("qty")).count() == 0


def test_monthly_changes_telescope(spark):
    r = running_qty(spark, SF_SMALL)
    mc = series.monthly_change(r, None, "sd", "total")
    months = r.groupBy(F.date_format("sd", "yyyy-MM").alias("m")).agg(F.max_by("total", "sd").alias("last"))
    first_last = months.agg(F.min_by("last", "m").alias("a"), F.max_by("last", "m").alias("b")).first()
    assert mc.agg(F.sum("change")).first()[0] == first_last["b"] - first_last["a"]


def test_loads_are_idempotent(spark):
    c = table(spark, SF_SMALL, "customer").select("c_custkey", "c_acctbal")
    batch = c.filter(F.col("c_acctbal") > 5000).withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("o", F.lit(0))
    once = loads.upsert(c, batch, "c_custkey", "o")
    twice = loads.upsert(once, batch, "c_custkey", "o")
    assert once.exceptAll(twice).count() == 0 and twice.count() == c.count()
    a1 = loads.append_ignore(c, batch, "c_custkey", "o")
    a2 = loads.append_ignore(a1, batch, "c_custkey", "o")
    assert a1.exceptAll(a2).count() == 0 and a2.count() == c.count()
    t1 = loads.truncate_load(c, batch.drop("o"))
    assert loads.truncate_load(t1, batch.drop("o")).exceptAll(t1).count() == 0


def test_snapshot_write_never_overwrites(spark, tmp_path):
    import pytest
    df = table(spark, SF_SMALL, "nation")
    p = str(tmp_path / "snap")
    loads.write_snapshot(df, p)
    with pytest.raises(Exception):
        loads.write_snapshot(df, p)


def test_upsert_partitions_leaves_other_partitions_untouched(spark, tmp_path):
    c = table(spark, SF_SMALL, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = str(tmp_path / "cust")
    c.write.partitionBy("c_mktsegment").parquet(path)

    def files(seg):
        d = os.path.join(path, f"c_mktsegment={seg}")
        return sorted(f for f in os.listdir(d) if f.endswith(".parquet"))
    before_building, before_machinery = files("BUILDING"), files("MACHINERY")
    batch = c.filter(F.col("c_mktsegment") == "MACHINERY").withColumn("c_acctbal", F.lit(1.0)).withColumn("seq", F.lit(1))
    loads.upsert_partitions(path, batch, "c_custkey", "seq", ["c_mktsegment"], str(tmp_path / "staging"))
    assert files("BUILDING") == before_building
    assert files("MACHINERY") != before_machinery
    out = spark.read.parquet(path)
    assert out.count() == c.count()
    assert out.filter((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") != 1.0)).count() == 0


def test_append_delta_only_adds_new_keys(spark, tmp_path):
    o = table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice")
    path = str(tmp_path / "orders")
    o.filter("o_orderkey % 2 = 0").write.parquet(path)
    n_files = len([f for f in os.listdir(path) if f.endswith(".parquet")])
    delta = loads.append_ignore_delta(spark.read.parquet(path), o.withColumn("ord", F.lit(0)), "o_orderkey", "ord")
    loads.commit_append(delta, path)
    back = spark.read.parquet(path)
    assert back.count() == o.count() and back.select("o_orderkey").distinct().count() == o.count()
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) > n_files


def test_incremental_commits_are_idempotent(spark, tmp_path):
    o = table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = str(tmp_path / "orders")
    o.filter("year < 1998").write.partitionBy("year").parquet(path)
    batch = o.withColumn("ord", F.lit(0))
    for _ in range(2):  # the second run finds every key committed and appends nothing
        loads.commit_append(loads.append_ignore_delta(spark.read.parquet(path), batch, "o_orderkey", "ord"), path, ["year"])
    back = spark.read.parquet(path)
    assert back.count() == o.count() and back.select("o_orderkey").distinct().count() == o.count()

    upd = o.filter("year = 1999").withColumn("o_totalprice", F.lit(1.0)).withColumn("ord", F.lit(1))
    for i in range(2):
        loads.upsert_partitions(path, upd, "o_orderkey", "ord", ["year"], str(tmp_path / f"staging{i}"))
    back = spark.read.parquet(path)
    assert back.count() == o.count()
    assert back.filter("year = 1999 AND o_totalprice != 1.0").count() == 0
