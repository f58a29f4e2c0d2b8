"""Header / tag-row detection must hold when one file is read in many splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import sources
from chronoframe.plans import fixtures as fz
from chronoframe.plans.q_sources import ORDERS_DDL
from chronoframe.session import scratch_path


def _orders(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return o


def _with_small_splits(spark, fn):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_preamble_in_many_splits(spark):
    o = _orders(spark)
    path = fz.write_csv_files(o, "split-preamble", lambda header: ["report", "junk line", "", header], files=1)

    def run():
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        return sources.scan_csv_preamble(spark, path, "o_orderkey,", ORDERS_DDL).collect()
    got = _with_small_splits(spark, run)
    assert sorted(map(tuple, got)) == sorted(map(tuple, o.select(*[c.split()[0] for c in ORDERS_DDL.split(", ")]).collect()))


def test_tagrow_in_many_splits(spark):
    o = _orders(spark)
    path = fz.write_csv_files(o, "split-tagrow", lambda header: [header, "#key,#cust,#status,#price,#date,#prio"], files=1)

    def run():
        return sources.scan_csv_tagrow(spark, path, ORDERS_DDL).collect()
    got = _with_small_splits(spark, run)
    assert len(got) == o.count()
    assert sorted(map(tuple, got)) == sorted(map(tuple, o.select(*[c.split()[0] for c in ORDERS_DDL.split(", ")]).collect()))


def test_tag_like_data_row_beyond_line_two_is_kept(spark):
    path = scratch_path(spark, "tag-kept")
    spark.createDataFrame([("a,b",), ("#x,#y",), ("1,2",), ("#3,4",)], "value string").coalesce(1).write.text(path)
    got = sources.scan_csv_tagrow(spark, path, "a string, b string").collect()
    assert sorted(map(tuple, got)) == [("#3", "4"), ("1", "2")]


def test_geojson_rings_and_dates_from_path(spark):
    import json
    import os
    from chronoframe.session import local_dir
    base = local_dir(scratch_path(spark, "geo-holes"))
    outer = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [outer, hole]}}]}
    for day in ("2024-09-11", "2024-09-12"):
        with open(os.path.join(base, f"{day}.geojson"), "w") as fh:
            json.dump(fc, fh)
    got = sources.scan_geojson(spark, base)
    assert got.count() == 2 * (5 + 4)
    assert {r[0] for r in got.select(F.col("date").cast("string")).distinct().collect()} == {"2024-09-11", "2024-09-12"}
    assert sorted({(r["ring"], r["vertex"]) for r in got.collect()})[-1] == (1, 3)


def test_zip_members_picked_by_name_each_header_dropped(spark):
    import io
    import os
    import zipfile
    from chronoframe.session import local_dir
    base = local_dir(scratch_path(spark, "zip-members"))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as zf:
        zf.writestr("daily_data_a.csv", "﻿a,b\n1,x\n2,y\n")
        zf.writestr("nested/daily_data_b.csv", "a,b\n3,z\n")
        zf.writestr("other.csv", "a,b\n9,no\n")
    with open(os.path.join(base, "one.zip"), "wb") as fh:
        fh.write(blob.getvalue())
    got = sources.scan_csv_in_zip(spark, base, r"^daily_data.*\.csv$", "a int, b string")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_typed_projection_skips_missing_declared_columns(spark):
    from chronoframe.operators import clean
    df = spark.createDataFrame([("7", "3.5", "")], "k string, v string, extra string")
    out = clean.typed_projection(df, {"k": "int", "v": "float", "missing": "date", "extra": "text"})
    assert out.columns == ["k", "v", "extra"]
    assert tuple(out.first()) == (7, 3.5, None)
