"""Inputs that the driver's tables do not have: several files, quoted CSV, long decimals, NULLs, duplicate keys."""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoframe.functions import numeric as fx
from chronoframe.operators import aggs, clean, joins, loads, series
from chronoframe.session import broadcast_below
from chronoframe.sources import files
from tests.conftest import SF_SMALL
from tests.plan_util import plan_text

QUOTED = 'id,name,n\n1,"Acme ""East"", Ltd",5\n2,"two\nlines",6\n3,plain,7\n'
EXPECTED = [(1, 'Acme "East", Ltd', 5), (2, "two\nlines", 6), (3, "plain", 7)]
DDL = "id int, name string, n int"


def test_stream_bucket_count_over_many_files(spark, tmp_path):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(16, F.rand(1)).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["X03_stream_bucket_count"](spark, str(tmp_path)).collect()
    one = entry.queries()["X03_stream_bucket_count"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, one))
    assert sum(r["count"] for r in got) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_scan_csv_quoting(spark, tmp_path):
    (tmp_path / "a.csv").write_text(QUOTED)
    assert sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "a.csv"), DDL).collect())) == EXPECTED


def test_scan_zip_quoting(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "﻿" + QUOTED)
    assert sorted(map(tuple, files.scan_csv_in_zip(spark, str(tmp_path), r"\.csv$", DDL).collect())) == EXPECTED


def test_scan_zip_long_field(spark, tmp_path):
    long = "x," * 100_000
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", f'a,b\n1,"{long}"\n')
    assert list(map(tuple, files.scan_csv_in_zip(spark, str(tmp_path), r"\.csv$", "a int, b string").collect())) == [(1, long)]


def test_line_readers_keep_doubled_quotes(spark, tmp_path):
    (tmp_path / "p.csv").write_text('note\nType,x\nA,"say ""hi"", you"\n')
    assert [tuple(r) for r in files.scan_csv_preamble(spark, str(tmp_path / "p.csv"), "Type,", "t string, x string").collect()] == [
        ("A", 'say "hi", you')]


def test_numeric_text_is_exact(spark):
    df = spark.createDataFrame([("1.239",), ("0.004",), ("0.004",), ("0.004",), ("1.2.3",), ("-1",)], "t string")
    assert float(df.agg(F.sum(fx.guarded_numeric("t"))).first()[0]) == 1.251
    assert float(aggs.value_fallback_sum(df.withColumn("k", F.lit(1)), "k", "t").first()["total"]) == 1.251


def test_lookup_takes_the_last_row(spark):
    df = spark.createDataFrame([("a", 10.0)], "k string, v double")
    look = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0)], "k string, i int, w double")
    assert joins.lookup_join(df, look, ["k"], "v", "w", scale=1.0, order="i").first()["w"] == 3.0


def test_null_lags_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 4.0)], "d int, x double")
    assert [r["d"] for r in series.pct_change_k(df, None, "d", "x", 1).orderBy("d").collect()] == [2, 3, 4]
    assert [r["d"] for r in series.diff_lag1(df, None, "d", ["x"]).orderBy("d").collect()] == [2, 3, 4]


def test_workers_need_no_package(spark, tmp_path):
    """Without the optional subpackage, in another folder, everything else imports."""
    import subprocess
    import sys
    root = Path(entry.__file__).parent
    shutil.copytree(root / "chronoframe", tmp_path / "chronoframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as e; q = e.queries(); "
            "assert 'pipeline' not in q and 'X03_stream_bucket_count' in q and set(e.oracle_sql()) <= set(q)" % str(tmp_path))
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/tmp")


def test_json_sink_converts_nested_values(spark, tmp_path):
    df = spark.sql("""SELECT named_struct('d', DATE'2024-01-02', 'x', CAST(1.50 AS DECIMAL(9,2))) AS s,
      array(DATE'2024-01-03', NULL) AS a, map('k', CAST(2 AS DECIMAL(5,1))) AS m, CAST(NULL AS STRUCT<d: DATE>) AS n, 7 AS i""")
    path = loads.sink_json(df, str(tmp_path / "out"))
    text = spark.read.text(path).first()[0]
    assert text == '{"s":{"d":"2024-01-02","x":1.5},"a":["2024-01-03",null],"m":{"k":2.0},"i":7}'


def test_update_from_last_wins(spark):
    target = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 9.0)], "k int, v double")
    side = spark.createDataFrame([(1, 5.0, 1), (1, 3.0, 2), (2, 4.0, 1), (2, None, 2)], "k int, v double, o int")
    got = {r["k"]: r["v"] for r in loads.update_from(target, side, "k", "v", order="o").collect()}
    assert got == {1: 3.0, 2: None, 3: 9.0}


def test_region_rollup_metadata_of_the_first_seen(spark):
    rows = [("r", "2024-01-01T00", 1.0, "b", 2), ("r", "2024-01-01T05", None, "a", 3), ("r", "2024-01-01T09", 2.0, "c", 1),
            ("r", "2024-01-01T09", 4.0, "d", None), ("q", "2024-01-01", None, None, None)]
    df = spark.createDataFrame(rows, "region string, ts string, v double, m string, o int")
    got = {r["region"]: (r["v"], r["m"]) for r in loads.region_rollup_load(df, "region", "ts", ["v"], ["m"], "o").collect()}
    assert got == {"r": (7.0, "c"), "q": (0.0, None)}


def test_duplicate_dictionary_labels_give_one_row_each(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    labels = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "k string, name string")
    assert sorted(r["label"] for r in clean.dict_label(df, "code", labels, "k", "name").collect()) == ["Code c", "x", "z"]
    assert sorted(r["code"] for r in clean.name_crosswalk(df, "code", labels, "k", "name").collect()) == ["c", "x", "z"]


def test_first_and_last_need_an_order(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for load in (loads.append_ignore, loads.append_ignore_delta, loads.upsert):
        with pytest.raises(TypeError):
            load(df, df, "k")


def test_only_a_side_of_known_size_is_hinted(spark):
    df = spark.range(10)
    assert "broadcast" in plan_text(df.join(broadcast_below(df, 10), "id"), "extended").lower().split("analyzed")[0]
    assert broadcast_below(df, 11, limit=10) is df
