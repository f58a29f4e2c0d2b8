"""Quoted records over splits, ZIP members as tasks, amounts of any length, key
filters, rows beside NULL, record sets and weekly anchoring over blocks."""

from __future__ import annotations

import csv
import datetime as dt
import io
import os
import random
import re
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronoframe import functions as fx
from chronoframe import sources
from chronoframe.operators import aggs, clean, joins, loads, series, shape
from chronoframe.operators.keyfilter import flag_possible, in_key_range, possible_keys
from chronoframe.session import local_dir, scratch_path
from chronoframe.sources.records import csv_records, ends_inside
from tests.plan_util import plan_text


@pytest.fixture
def splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "1")
    yield lambda size: spark.conf.set(names[0], str(size))
    for n, v in old.items():
        spark.conf.set(n, v)


# -- records ------------------------------------------------------------------

def field(rnd) -> str:
    if rnd.random() < 0.4:
        return rnd.choice(["a", "12", "", "x y", "é"])
    return "".join(rnd.choice(['"', "\n", ",", "b", "c\r\n", "d", " ", '""', "\n\n"]) for _ in range(rnd.randrange(0, 12)))


def land_records(spark, seed: int, head: str, name: str) -> tuple[str, list[tuple]]:
    rnd = random.Random(seed)
    base, want = local_dir(scratch_path(spark, name)), []
    for f in range(3):
        body = "col,b,c\n" + ("#t,#u,#v\n" if name == "tags" else "")
        for _ in range(rnd.randrange(0, 50)):
            out = []
            for k, x in enumerate([field(rnd), field(rnd), rnd.choice(['5" gun', "z", ""])]):
                quote = any(c in x for c in "\n\r,") or x[:1] == '"' or (k < 2 and rnd.random() < 0.2)
                out.append('"' + x.replace('"', '""') + '"' if quote else x)
            body += ",".join(out) + "\n"
        with open(os.path.join(base, f"f{f}.csv"), "w", newline="", encoding="utf-8") as fh:
            fh.write(head + body)
        rows = list(csv.reader(io.StringIO(body, newline="")))[2 if name == "tags" else 1:]
        want += [tuple(x or None for x in r) for r in rows if r and r != [""]]
    return base, sorted(want, key=str)


def values(df) -> list[tuple]:
    return sorted((tuple(x or None for x in r) for r in df.collect()), key=str)


THREE = "a string, b string, c string"


@pytest.mark.parametrize("size", [7, 60, 1 << 20])
def test_records_with_quoted_line_breaks_over_splits(spark, splits, size):
    splits(size)
    path, want = land_records(spark, size, "", "plain")
    assert values(sources.scan_csv(spark, path, THREE)) == want
    path, want = land_records(spark, size + 1, 'free 5" text\n"open\n\n', "preamble")
    assert values(sources.scan_csv_preamble(spark, path, "col,", THREE)) == want
    path, want = land_records(spark, size + 2, "", "tags")
    assert values(sources.scan_csv_tagrow(spark, path, THREE)) == want


def test_one_large_quoted_file_is_many_tasks(spark, splits):
    base = local_dir(scratch_path(spark, "one-file"))
    with open(os.path.join(base, "one.csv"), "w", encoding="utf-8") as fh:
        fh.write("k,t\n" + "".join(f'{i},"line {i}\nsaid ""x"", {i}"\n' for i in range(3000)))
    splits(8192)
    df = sources.scan_csv(spark, base, "k int, t string")
    assert spark.read.text(base).rdd.getNumPartitions() > 8
    assert "MapInArrow" in plan_text(df, "simple")
    got = df.collect()
    assert sorted((r["k"], r["t"]) for r in got) == [(i, f'line {i}\nsaid "x", {i}') for i in range(3000)]


def test_large_file_without_quotes_needs_no_python(spark, splits):
    path = scratch_path(spark, "no-quotes")
    spark.range(2000).selectExpr("id AS k", "'x' AS t").coalesce(1).write.option("header", True).csv(path)
    splits(2048)
    df = sources.scan_csv(spark, path, "k long, t string")
    assert "Arrow" not in plan_text(df, "simple") and df.count() == 2000


def test_unterminated_quote_bom_and_blank_lines(spark, splits):
    splits(11)
    base = local_dir(scratch_path(spark, "ragged"))
    with open(os.path.join(base, "a.csv"), "wb") as fh:
        fh.write('﻿k,t\r\n1,"x"\r\n\r\n2,"open\r\nto the end'.encode())
    with open(os.path.join(base, "empty.csv"), "wb"):
        pass
    got = sorted((r["rec"], r["value"]) for r in csv_records(spark, base).collect())
    assert got == [(0, "k,t"), (1, '1,"x"'), (2, ""), (3, '2,"open\r\nto the end')]
    assert csv_records(spark, base, marker="nowhere").collect() == []


@pytest.mark.parametrize("line,outside,inside", [
    ('a,"b', True, False), ('a,5" x,"b', True, True), ('a,"b""', True, False), ('x","y', True, True), ('x",y', False, False),
    ('a,"b"c,d', False, False), ("", False, True), ('"', True, False), ('""', False, True), ('"""', True, False)])
def test_quote_state_of_a_line(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


# -- ZIP ----------------------------------------------------------------------

def test_each_zip_member_is_a_task(spark):
    base = local_dir(scratch_path(spark, "zip-tasks"))
    for a in range(2):
        with zipfile.ZipFile(os.path.join(base, f"a{a}.zip"), "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(5):
                z.writestr(f"in/data_{m}.csv", "﻿k,t\n" + "".join(f'{a * 100 + m * 10 + i},"x\n""{i}"""\n' for i in range(3)))
            z.writestr("data_9.txt", "k,t\n9,no\n")
            z.writestr("data_bad.csv", b"k,t\n7,\xff\xfe\n")
    df = sources.scan_csv_in_zip(spark, base, r"^data_\w+\.csv$", "k int, t string")
    assert df.rdd.getNumPartitions() == 12
    got = sorted(map(tuple, df.collect()))
    assert got == sorted([(a * 100 + m * 10 + i, f'x\n"{i}"') for a in range(2) for m in range(5) for i in range(3)]
                         + [(7, "��")] * 2)


def test_zip_landing_without_archives_or_members(spark):
    base = local_dir(scratch_path(spark, "zip-none"))
    assert sources.scan_csv_in_zip(spark, base, "x", "k int").collect() == []
    with zipfile.ZipFile(os.path.join(base, "a.zip"), "w") as z:
        z.writestr("other.csv", "k\n1\n")
    assert sources.scan_csv_in_zip(spark, base, "^data", "k int").collect() == []


# -- amounts ------------------------------------------------------------------

def value_of(t: str | None) -> Fraction:
    if t is None or not re.fullmatch("[0-9.]+", t) or t.count(".") > 1 or not re.search("[0-9]", t):
        return Fraction(0)
    a, _, b = t.partition(".")
    return Fraction(int((a or "0") + b), 10 ** len(b))


def amounts(n: int = 500) -> list[tuple]:
    rnd = random.Random(2)
    odd = [None, "", ".", "1.2.3", "-3", "1e6", "..", "5.", ".5", "000", "0.000", "00012.3400", " 12", "123456789012345678901",
           "0.1234567890123456789012345678901234567890"]
    rows = [("a", t) for t in odd]
    for _ in range(n):
        whole = "".join(rnd.choice("0123456789") for _ in range(rnd.choice([0, 1, 3, 9, 10, 18, 27, 28, 40, 100])))
        part = "".join(rnd.choice("0009") for _ in range(rnd.choice([0, 0, 2, 9, 18, 19, 30, 60])))
        rows.append((rnd.choice(["a", "b", None]), whole + ("." + part if part else "")))
    return rows


def test_amounts_of_any_length(spark):
    rows = amounts()
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    for r in clean.guarded_numeric(df.withColumn("d", fx.guarded_numeric("t", 18)), "t", "x").collect():
        v = value_of(r["t"])
        assert Fraction(r["x"]) == v and not re.match("0[0-9]", r["x"]) and not re.search(r"\.[0-9]*0$", r["x"])
        fits = (v * 10 ** 18).denominator == 1 and v < 10 ** 20
        assert (r["d"] is not None) == fits and (not fits or Fraction(r["d"]) == v)
    got = {r["k"]: r for r in aggs.value_fallback_sum(df, "k", "t").collect()}
    for k in ("a", "b", None):
        assert Fraction(got[k]["total"]) == sum((value_of(t) for q, t in rows if q == k), Fraction(0))
        assert got[k]["count"] == sum(q == k for q, _ in rows)
    assert Fraction(aggs.value_fallback_sum(df, None, "t").first()["total"]) == sum((value_of(t) for _, t in rows), Fraction(0))


def test_carries_run_through_all_limbs(spark):
    df = spark.createDataFrame([("9" * 41 + "." + "9" * 30,)] * 1000 + [("0." + "0" * 29 + "1",)], "t string")
    assert aggs.value_fallback_sum(df, None, "t").first()["total"] == str(10 ** 44 - 1) + "." + "9" * 27 + "001"
    assert aggs.value_fallback_sum(df.limit(0), None, "t").collect()[0] == ("0", 0)


# -- key filters --------------------------------------------------------------

def test_key_filter_keeps_every_key_of_the_batch(spark):
    table = spark.range(20_000).select((F.col("id") * 3).alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    batch = spark.createDataFrame([(i,) for i in (3, 3000, 59_997, 1, 2)] + [(None,)], "k long")
    flagged = flag_possible(table, batch, ["k"], bitmaps=4)
    assert flagged.filter("__possible AND k IN (3, 3000, 59997)").count() == 3
    assert flagged.filter("__possible").count() < 10 and flagged.count() == 20_000
    assert {r["k"] for r in possible_keys(table, batch, ["k"]).collect()} >= {3, 3000, 59_997}
    assert flag_possible(table, batch.limit(0), ["k"]).filter("__possible").count() == 0


def _stored(spark, name):
    path = scratch_path(spark, name)
    spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit(0).alias("seq")).write.parquet(path)
    return spark.read.parquet(path)


def test_target_is_not_shuffled(spark):
    target = _stored(spark, "key-filter-target")
    batch = spark.createDataFrame([(5, 50, 1), (5, 51, 2), (70_000, 1, 1)], "k long, v long, seq int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (joins.anti_existing(batch, target, "k"), loads.append_ignore_delta(target, batch, "k", "seq"),
                   loads.upsert(target, batch, "k", "seq")):
            got = df.collect()
            text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "BroadcastHashJoin" in text  # the filter, at the scan
        assert len(got) == 50_001 and {tuple(r) for r in got if r["k"] in (5, 70_000)} == {(5, 51, 2), (70_000, 1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [r["k"] for r in joins.anti_existing(batch, target, "k").collect()] == [70_000]
    assert [tuple(r) for r in loads.append_ignore_delta(target, batch, "k", "seq").collect()] == [(70_000, 1, 1)]


def test_rows_that_reach_a_shuffle_are_few(spark):
    """Bytes, not only plan shape: what the filter lets pass of 50,000 target rows."""
    target = _stored(spark, "key-filter-bytes")
    batch = spark.createDataFrame([(i * 499,) for i in range(100)], "k long")
    assert possible_keys(target, batch, ["k"]).count() <= 110
    assert in_key_range(target, batch.filter("k < 1000"), ["k"]).count() == 999


# -- rows beside NULL, lookups, record sets ------------------------------------

def test_rate_keeps_rows_whose_window_ends_at_null(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i * i)) for i in range(7)], "i int, v double")
    got = {r["i"]: r["rate"] for r in series.rate_of_change(df, None, "i", "v", 2).collect()}
    assert got == {1: None, 2: (9 - 1) / 2 * 30.0, 3: None, 4: (25 - 9) / 2 * 30.0, 5: (36 - 16) / 2 * 30.0}
    assert [r["rate"] for r in series.rate_of_change(df, None, "i", "v", 1).collect()] == [None] * 7


def test_months_that_end_on_null_stay(spark):
    rows = [(dt.date(2024, 1, 31), 1.0), (dt.date(2024, 2, 1), 2.0), (dt.date(2024, 2, 29), None), (dt.date(2024, 3, 5), 7.0),
            (dt.date(2024, 4, 5), 9.0)]
    got = series.monthly_change(spark.createDataFrame(rows, "d date, v double"), None, "d", "v")
    assert sorted(map(tuple, got.collect())) == [("2024-02", None), ("2024-03", None), ("2024-04", 2.0)]


def test_lookup_without_order_must_be_unique(spark):
    df = spark.createDataFrame([("x", 6.0)], "k string, v double")
    twice = spark.createDataFrame([("x", 5.0, 1), ("x", 3.0, 2)], "k string, w double, i int")
    with pytest.raises(Exception, match="need an order"):
        joins.lookup_join(df, twice, ["k"], "v", "w").collect()
    assert joins.lookup_join(df, twice, ["k"], "v", "w", scale=1.0, order="i").first()["ratio"] == 2.0
    with pytest.raises(Exception, match="need an order"):
        loads.update_from(df, twice, "k", "v", "w").collect()


def test_overlay_keeps_all_rows_of_the_last_frame(spark):
    a, b, c = (spark.createDataFrame(r, "k string, v int") for r in (
        [("p", 1), ("p", 1), ("q", 1), (None, 1)], [("q", 2), ("q", 3)], [(None, 4), (None, 5)]))
    got = shape.overlay_by_key([a, b, c], "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("p", 1), ("p", 1), ("q", 2), ("q", 3), (None, 4), (None, 5)], key=str)


# -- weekly anchoring ----------------------------------------------------------

def anchored_by_hand(rows, days):
    rows = sorted(rows, key=lambda r: r[0])
    anchor, out = rows[0], []
    for d, v in rows:
        if (d - anchor[0]).days >= days:
            out.append((d, None if v is None or anchor[1] is None else v - anchor[1], v))
            anchor = (d, v)
    return out


@pytest.mark.parametrize("days,block", [(7, 512), (7, 8), (1, 3), (30, 64)])
def test_weekly_anchoring_over_blocks(spark, days, block):
    rnd, rows = random.Random(3), []
    for k, n in (("a", 400), ("b", 1), (None, 300), ("c", 60)):
        d = dt.date(1965, 1, 1) + dt.timedelta(rnd.randrange(3000))
        for _ in range(n):
            rows.append((k, d, rnd.choice([None, 1.5, float(rnd.randrange(100))])))
            d += dt.timedelta(rnd.choice([1, 1, 1, 2, 3, 7, 20, 200]))
    df = spark.createDataFrame(rows, "k string, d date, v double").repartition(4)
    got = series.week_anchor_change(df, "k", "d", "v", days, block)
    want = [(k, *x) for k in ("a", "b", None, "c") for x in anchored_by_hand([r[1:] for r in rows if r[0] == k], days)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    one = series.week_anchor_change(df.filter("k = 'a'").drop("k"), None, "d", "v", days, block)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(
        anchored_by_hand([r[1:] for r in rows if r[0] == "a"], days), key=str)
    assert not any(w in plan_text(one) for w in ("InPandas", "InArrow", "EvalPython"))


# -- exports, footers, variants ------------------------------------------------

def test_rows_are_counted_by_the_writing_job(spark):
    outs = {f"o{n}": spark.range(n).select("id", F.lit(dt.date(2024, 1, 1)).alias("d")) for n in (0, 1, 700)}
    outs["none"] = spark.createDataFrame([], "id long, d date")
    base = scratch_path(spark, "observed")
    got = {r["output"]: r["rows"] for r in loads.export_outputs(outs, base).collect()}
    assert got == {"o0": 0, "o1": 1, "o700": 700, "none": 0}
    assert spark.read.json(f"{base}/o700").count() == 700
    with pytest.raises(Exception):  # a folder that is there already fails the export
        loads.export_outputs(outs, base)


def test_numbers_come_from_footers(spark):
    path = scratch_path(spark, "footers")
    spark.range(100, 5000).select(F.col("id").alias("k"), (F.col("id") / 2).alias("x"), F.col("id").cast("string").alias("t"),
                                  F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("d")).write.parquet(path)
    with sources.footer_aggregates(spark):
        assert "PushedAggregation: [COUNT(*), MIN(k), MAX(k), MIN(d), MAX(d)]" in plan_text(sources.footer_query(spark, path, ["k", "d"]))
    old = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = sources.footer_stats(spark, path, ["t", "k", "x", "d"]).first().asDict()
    assert got == {"count": 4900, "min_t": "100", "max_t": "999", "min_k": 100, "max_k": 4999, "min_x": 50.0, "max_x": 2499.5,
                   "min_d": dt.date(2024, 1, 1), "max_d": dt.date(2024, 3, 30)}
    assert "parquet" in old and spark.conf.get("spark.sql.sources.useV1SourceList") == old
    empty = scratch_path(spark, "footers-empty")
    spark.createDataFrame([], "k long").write.parquet(empty)
    assert tuple(sources.footer_stats(spark, empty, ["k"]).first()) == (0, None, None)


def test_pages_that_differ_in_keys_and_types(spark):
    base = local_dir(scratch_path(spark, "variant"))
    pages = ['{"data": [{"a": 1, "odd key*": "x"}, {"a": "2.5"}]}', '{"data": [{"odd key*": {"b": 1}, "a": null}, {}]}', "no json",
             '{"other": 1}', '{"data": []}']
    for i, text in enumerate(pages):
        with open(os.path.join(base, f"{i}.json"), "w", encoding="utf-8") as fh:
            fh.write(text)
    got = sources.scan_json_variant(spark, base, "$.data", {"a": ("$.a", "double"), "o": ("$['odd key*']", "string")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1.0, "x"), (2.5, None), (None, '{"b":1}'), (None, None)], key=str)


# -- series, order, streams ----------------------------------------------------

@pytest.mark.parametrize("window", [33, 365])
def test_wide_median_against_sorted_lists(spark, window, monkeypatch):
    rnd, rows = random.Random(4), []
    for k, n in (("a", 900), (None, 50), ("b", 1)):
        rows += [(k, i, rnd.choice([None, float(rnd.randrange(50))])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    got = {(r["k"], r["i"]): r["m"] for r in series.rolling_median(df, "k", "i", "v", window, "m").collect()}
    half = window // 2
    for k in ("a", None, "b"):
        xs = [v for q, _, v in rows if q == k]
        for i in range(len(xs)):
            near = sorted(x for x in xs[max(0, i - half):i + half + 1] if x is not None)
            assert got[k, i] == (near[len(near) // 2] if near else None)


def test_a_long_series_is_cut_into_runs(spark, monkeypatch):
    from chronoframe.operators import series as module
    monkeypatch.setattr(module, "SORTED_ROWS", 3)
    xs = [float((i * 7919) % 1009) for i in range(9000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double")
    got = {r["i"]: r["smoothed"] for r in series.rolling_median(df, None, "i", "v", 41).collect()}
    for i in (0, 5, 4075, 4095, 4096, 4116, 8191, 8192, 8999):
        near = sorted(xs[max(0, i - 20):i + 21])
        assert got[i] == near[len(near) // 2]


def test_many_series_against_pairwise_correlation(spark):
    rnd = random.Random(6)
    rows = [(f"s{s:03d}", f"d{d:02d}", float(rnd.randrange(-5, 20))) for s in range(60) for d in range(30) if rnd.random() < 0.8]
    rows += [("flat", f"d{d:02d}", 2.0) for d in range(30)] + [("s001", "d01", 3.0), ("s002", "d03", None), (None, "d05", 1.0)]
    df = spark.createDataFrame(rows, "s string, d string, v double").repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in aggs.correlation_matrix_long(df, "s", "d", "v", 7, 16).collect()}
    names = sorted({s for s, _, _ in rows if s})
    assert len(got) == len(names) ** 2
    x = {s: [sum(v or 0 for t, e, v in rows if t == s and e == f"d{d:02d}") for d in range(30)] for s in names}
    for a, b in [("s000", "s001"), ("s001", "s000"), ("s002", "s059"), ("flat", "s003"), ("s004", "s004"), ("flat", "flat")]:
        n, sa, sb = 30, sum(x[a]), sum(x[b])
        var = (n * sum(v * v for v in x[a]) - sa * sa) * (n * sum(v * v for v in x[b]) - sb * sb)
        want = 1.0 if a == b else (n * sum(p * q for p, q in zip(x[a], x[b], strict=True)) - sa * sb) / var ** 0.5 if var else 0.0
        assert got[a, b] == pytest.approx(want, abs=1e-12)
    assert aggs.correlation_matrix_long(df.limit(0), "s", "d", "v").collect() == []


def test_locale_order(spark):
    names = ["zebra", "Äpfel", "apfel", "Zoo", "éclair", "eclair", "Apfel"]
    df = spark.createDataFrame([(n, 1) for n in names], "n string, v int")
    assert [r["n"] for r in shape.distinct_values(df, ["n"], "UNICODE").collect()] == [
        "apfel", "Apfel", "Äpfel", "eclair", "éclair", "zebra", "Zoo"]
    assert [r["n"] for r in shape.distinct_values(df, ["n"]).collect()] == sorted(names)
    assert [r["n"] for r in shape.priority_sort(df, "n", ["zebra"], collation="UNICODE").collect()][:2] == ["zebra", "apfel"]
    assert [r["n"] for r in shape.top_k_resorted(df, "v", 4, "n", "UNICODE").collect()] == ["apfel", "Apfel", "Äpfel", "eclair"]


def test_bound_scan_leaves_no_view(spark):
    path = scratch_path(spark, "bound")
    spark.range(10).write.parquet(path)
    before = {t.name for t in spark.catalog.listTables()}
    assert sources.scan_table(spark, path, ["id"], "id > :x", {"x": 7}).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_old_snapshots_go(spark):
    from chronoframe import streaming as st
    src, schema = scratch_path(spark, "snapshots"), "k long, v long, seq long"
    target, ckpt = st.stream_dirs(spark, "snapshots-out")
    for i in range(4):
        spark.createDataFrame([(1, i, i), (10 + i, i, i)], schema).coalesce(1).write.mode("append").parquet(src)
        st.run_available(st.stream_upsert(st.read_stream(spark, src, schema), target, ["k"], "seq", ckpt), spark)
    assert sorted(n for n in os.listdir(target.removeprefix("file:")) if n.startswith("batch=")) == [
        "batch=000000002", "batch=000000003"]
    assert sorted(map(tuple, st.read_latest_snapshot(spark, target).select("k", "v").collect())) == [
        (1, 3), (10, 0), (11, 1), (12, 2), (13, 3)]


def test_change_points_of_shuffled_landings(spark):
    from chronoframe import streaming as st
    rnd = random.Random(1)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(i), float(rnd.randrange(30))) for k in "ab" for i in range(60) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    want = sorted(map(tuple, series.change_points(df, "k", "d", "v", 8.0).collect()))
    src = scratch_path(spark, "late")
    shuffled = sorted(rows, key=lambda r: r[1].toordinal() + rnd.randrange(9))
    for i in range(0, len(shuffled), 40):
        spark.createDataFrame(shuffled[i:i + 40], df.schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(None, dt.date(2024, 9, 1), None)], df.schema).coalesce(1).write.mode("append").parquet(src)
    out, ckpt = st.stream_dirs(spark, "late-out")
    with st.use_rocksdb(spark):
        found = st.stream_change_points_late(st.read_stream(spark, src, df.schema, max_files=1), "k", "d", "v", 8.0, "10 days")
        st.run_available(found.writeStream.outputMode("append").format("parquet").option("path", out)
                         .option("checkpointLocation", ckpt), spark)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect() if r["k"]) == want
