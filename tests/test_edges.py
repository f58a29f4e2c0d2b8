"""Hand-built rows for the edge cases the reference's semantics hinge on."""

from __future__ import annotations

import datetime as dt

import pytest


from chronoframe import functions as fx
from chronoframe.operators import aggs, clean, joins, loads, series, shape

D = dt.date


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "k string, v double")
    out = {r["k"]: (r["count"], r["total"]) for r in aggs.group_count_sum(df, "k", "v").collect()}
    assert out == {"a": (1, 1.0), None: (2, 5.0)}
    assert None not in {r["k"] for r in aggs.group_count_sum(df, "k", "v", drop_null_keys=True).collect()}


def test_pearson_zero_variance_and_empty(spark):
    const = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert aggs.pearson(const, "x", "y").first()["r"] == 0.0
    empty = const.filter("x > 10")
    assert aggs.pearson(empty, "x", "y").first()["r"] == 0.0
    perfect = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert aggs.pearson(perfect, "x", "y").first()["r"] == pytest.approx(1.0)


def test_rolling_median_is_upper_median(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 9, 2, 8, 3, 7])], "i int, v double")
    got = [r["smoothed"] for r in series.rolling_median(df, None, "i", "v", 7).orderBy("i").collect()]
    ref = []
    vals = [1, 9, 2, 8, 3, 7]
    for i in range(len(vals)):
        s = sorted(vals[max(0, i - 3): i + 4])
        ref.append(float(s[len(s) // 2]))
    assert got == ref


def test_step_interpolate_threshold_is_strict(spark):
    # diffs exactly 0.5 are not change points; 0.6 is.
    vals = [0.0, 0.5, 1.0, 1.6, 1.6, 1.6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["interpolated"] for r in series.step_interpolate(df, None, "i", "v").orderBy("i").collect()]
    # change points: 0 (first), 3 (|1.6-1.0|>0.5), 5 (last)
    exp = [0.0, 1.6 / 3, 2 * 1.6 / 3, 1.6, 1.6, 1.6]
    assert got == pytest.approx(exp)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_series(spark, n):
    df = spark.createDataFrame([(i, float(i * 2 + 1)) for i in range(n)], "i int, v double")
    assert series.step_interpolate(df, None, "i", "v").count() == n
    tr = aggs.linear_trend(df, "i", "v").orderBy("i").collect()
    assert len(tr) == n
    if n == 1:
        assert tr[0]["slope"] == 0.0 and tr[0]["intercept"] == 1.0
    if n == 2:
        assert tr[0]["slope"] == pytest.approx(2.0) and tr[1]["trend"] == pytest.approx(3.0)


def test_change_points_last_emitted(spark):
    vals = [100, 105, 109, 110, 111, 121, 111.5]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    got = [r["v"] for r in series.change_points(df, None, "i", "v", 10.0).orderBy("i").collect()]
    # 110 is exactly 10 away from 100 (not emitted); 111 is 11 away; 121 is 10 away from 111 (not); 111.5 not.
    assert got == [100.0, 111.0]


def test_week_anchor_gaps(spark):
    days = [D(2024, 1, 1), D(2024, 1, 3), D(2024, 1, 8), D(2024, 1, 9), D(2024, 1, 20), D(2024, 1, 26), D(2024, 1, 27)]
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(days)], "k string, d date, v double")
    got = rows(series.week_anchor_change(df, "k", "d", "v"), "d", "change")
    assert got == [(D(2024, 1, 8), 2.0), (D(2024, 1, 20), 2.0), (D(2024, 1, 27), 2.0)]


def test_pct_change_zero_previous(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 10.0)], "i int, v double")
    got = [r["rate"] for r in series.pct_change_k(df, None, "i", "v", 1).orderBy("i").collect()]
    assert got == [0.0, 100.0]


def test_prior_mean_fixed_divisor(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    got = [r["rolling_avg"] for r in series.prior_mean(df, None, "i", "v", 7).orderBy("i").collect()]
    assert got == [round(sum(range(0, 7)) / 7, 2), round(sum(range(1, 8)) / 7, 2), round(sum(range(2, 9)) / 7, 2)]


def test_near_events_strict_three_days(spark):
    p = spark.createDataFrame([(D(2024, 1, 10),)], "a date")
    e = spark.createDataFrame([(1, D(2024, 1, 7)), (2, D(2024, 1, 8)), (3, D(2024, 1, 12)), (4, D(2024, 1, 13))], "id int, b date")
    assert sorted(r["id"] for r in joins.near_events(p, e, "a", "b", 3).collect()) == [2, 3]


def test_guarded_numeric_dirty_values(spark):
    df = spark.createDataFrame([("1.2.3",), ("-5",), ("",), ("1e6",), ("12.5",), (None,)], "t string")
    got = [None if r[0] is None else float(r[0]) for r in df.select(fx.guarded_numeric("t")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 12.5, 0.0]


def test_parse_mixed_dates(spark):
    df = spark.createDataFrame([("31.12.2023",), ("2023-12-31T10:00",), ("Not available",), ("99.99.2020",), (None,)], "t string")
    got = [r[0] for r in clean.parse_mixed_date(df, "t").select("parsed_date").collect()]
    assert got == [D(2023, 12, 31), D(2023, 12, 31), None, None, None]
    dn = spark.createDataFrame([("25 January 2026",), ("2026-01-25",), ("junk",)], "t string")
    assert [r[0] for r in clean.parse_mixed_date(dn, "t", "dayname").select("parsed_date").collect()] == \
        [D(2026, 1, 25), D(2026, 1, 25), None]


def test_week_bucket_is_monday(spark):
    df = spark.createDataFrame([(D(2022, 2, 27),), (D(2022, 2, 28),)], "d date")  # Sunday, Monday
    got = [r[0] for r in df.select(fx.bucket("d", "week")).collect()]
    assert got == [D(2022, 2, 21), D(2022, 2, 28)]


def test_total_fallback_null_part(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 1, 2), (5, None, None)], "t int, a int, b int")
    assert [r["t"] for r in clean.total_fallback(df, "t", ["a", "b"]).collect()] == [0, 3, 5]


def test_falsy_null_and_rounding_modes(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in clean.falsy_null(df, "x").select("x").collect()] == [None, 2.5, -2.5]
    got = df.select(fx.round_to("x", 0, "half_up").alias("u"), fx.round_to("x", 0, "half_even").alias("e"),
                    fx.round_to("x", 0, "js").alias("j")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (3.0, 2.0, 3.0), (-3.0, -2.0, -2.0)]


def test_append_ignore_first_in_batch_and_existing(spark):
    t = spark.createDataFrame([(1, "old")], "k int, v string")
    b = spark.createDataFrame([(1, "new", 0), (2, "first", 0), (2, "second", 1)], "k int, v string, o int")
    assert rows(loads.append_ignore(t, b, "k", "o"), "k", "v") == [(1, "old"), (2, "first")]


def test_upsert_last_in_batch_wins(spark):
    t = spark.createDataFrame([(1, "old"), (3, "keep")], "k int, v string")
    b = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k int, v string, o int")
    assert rows(loads.upsert(t, b, "k", "o"), "k", "v") == [(1, "b"), (2, "c"), (3, "keep")]


def test_truncate_load_empty_batch_is_noop(spark):
    t = spark.createDataFrame([(1,)], "k int")
    assert rows(loads.truncate_load(t, t.filter("k > 5"))) == [(1,)]
    assert rows(loads.truncate_load(t, spark.createDataFrame([(7,)], "k int"))) == [(7,)]


def test_delete_range_load_drops_newer_rows(spark):
    t = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 5, 9)], "d date")
    b = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 6),)], "d date")
    assert rows(loads.delete_range_load(t, b, "d"), "d") == [(D(2024, 1, 1),), (D(2024, 1, 4),), (D(2024, 1, 6),)]
    assert rows(loads.delete_range_load(t, b.filter("d < '2000-01-01'"), "d"), "d") == rows(t, "d")


def test_update_from_matched_null_overwrites(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, v double")
    s = spark.createDataFrame([(1, None)], "k int, v double")
    assert rows(loads.update_from(t, s, "k", "v"), "k", "v") == [(1, None), (2, 20.0)]


def test_high_water_mark_default(spark):
    t = spark.createDataFrame([], "d date")
    b = spark.createDataFrame([(D(2021, 12, 31),), (D(2022, 3, 1),)], "d date")
    assert rows(loads.high_water_mark(t, b, "d", default="2022-02-24")) == [(D(2022, 3, 1),)]


def test_detect_changes_reasons(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 2), 5), ("b", D(2024, 1, 1), 5), ("c", None, 3), ("d", None, 1)],
                              "key string, max_date date, count long")
    b = spark.createDataFrame([("a", D(2024, 1, 1), 5), ("b", D(2024, 1, 1), 5), ("c", None, 4)],
                              "key string, max_date date, count long")
    got = {r["key"]: r["reason"] for r in loads.detect_changes(s, b).collect()}
    assert got == {"a": "max_date", "b": "unchanged", "c": "count", "d": "new"}


def test_staleness_decodes_int_kinds(spark):
    df = spark.createDataFrame([(20240131120000, 20240131, 2023, "2024-01-31T00:00", "garbage")],
                               "a long, b int, c int, t string, g string")
    frames = {k: (df, k) for k in ["a", "b", "c", "t", "g"]}
    got = {r["table_name"]: r["max_date"] for r in loads.staleness_report(frames, "2024-02-10").collect()}
    assert got == {"a": D(2024, 1, 31), "b": D(2024, 1, 31), "c": D(2023, 1, 1), "t": D(2024, 1, 31), "g": None}


def test_flags_zero_in_totals_absent_monthly(spark):
    df = spark.createDataFrame([(D(2024, 1, 5), 1, 0), (D(2024, 2, 5), 1, 0)], "d date, a int, b int")
    tot = {r["label"]: r["count"] for r in aggs.flags_to_counts(df, {"a": "A", "b": "B"}).collect()}
    assert tot == {"A": 2, "B": 0}
    monthly = aggs.flags_to_counts(df, {"a": "A", "b": "B"}, date="d")
    assert {r["label"] for r in monthly.collect()} == {"A"}


def test_explode_count_drops_null_keeps_multiplicity(spark):
    df = spark.createDataFrame([(["x", "x", "y"],), (None,), ([],)], "a array<string>")
    assert {r["item"]: r["count"] for r in aggs.explode_count(df, "a").collect()} == {"x": 2, "y": 1}


def test_monthly_change_end_to_end(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 1, 31), 3.0), (D(2024, 3, 2), 10.0)], "d date, v double")
    assert rows(series.monthly_change(df, None, "d", "v"), "month", "change") == [("2024-03", 7.0)]


def test_pivot_and_dense_grid_fill_zero(spark):
    df = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 2)], "t string, c string, n int")
    assert rows(shape.pivot_sum(df, "t", "c", "n", ["a", "b"]), "t", "a", "b") == [("d1", 1, 0), ("d2", 0, 2)]
    g = shape.dense_grid(df, "t", "c", "n", ["a", "b"])
    assert rows(g, "t", "c", "n") == [("d1", "a", 1), ("d1", "b", 0), ("d2", "a", 0), ("d2", "b", 2)]


def test_filter_in_set_empty(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert clean.filter_in_set(df, "c", []).count() == 0


def test_superset_member_appends_sum(spark):
    df = spark.createDataFrame([("x", "m1", 1), ("y", "m1", 2), ("z", "m1", 5)], "who string, month string, n long")
    out = rows(aggs.superset_member(df, "who", ["x", "y"], "XY", ["month"], ["n"]), "who", "n")
    assert ("XY", 3) in out and len(out) == 4


def test_assign_periods_inclusive_and_overlapping(spark):
    df = spark.createDataFrame([(20220101,), (20220331,), (20220401,), (20211231,)], "d int")
    got = rows(loads.assign_periods(df, "d", {"q1": (20220101, 20220331), "h1": (20220101, 20220630)}), "d", "period")
    assert got == [(20220101, "h1"), (20220101, "q1"), (20220331, "h1"), (20220331, "q1"), (20220401, "h1")]


def test_inverse_pair_join_needs_both_directions(spark):
    p = spark.createDataFrame([("A", "B", 3, 1.0), ("B", "A", 5, 2.0), ("A", "C", 4, 0.5), ("C", "C", 9, 9.0)],
                              "src string, dst string, n long, avg double")
    got = rows(joins.inverse_pair_join(p, "src", "dst", ["n", "avg"]), "src", "dst", "n_ab", "n_ba", "avg_ab", "avg_ba")
    assert got == [("A", "B", 3, 5, 1.0, 2.0)]


def test_latest_per_series_absent_is_zero(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 2), 4), ("b", D(2024, 1, 1), 7), ("a", D(2024, 1, 1), 1)],
                               "k string, d date, n long")
    assert rows(series.latest_per_series(df, "k", "d", "n"), "k", "latest") == [("a", 4), ("b", 0)]


def test_pivot_diff_grid_uses_all_dates(spark):
    df = spark.createDataFrame([("x", D(2024, 1, 1), 2), ("y", D(2024, 1, 2), 5), ("x", D(2024, 1, 3), 1)],
                               "k string, d date, n long")
    got = rows(series.pivot_diff(df, "k", "d", "n", ["x"]), "d", "x")
    assert got == [(D(2024, 1, 2), -2), (D(2024, 1, 3), 1)]


def test_dense_grid_infers_categories(spark):
    df = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 2), ("d2", "b", 3)], "t string, c string, n int")
    g = shape.dense_grid(df, "t", "c", "n")
    assert rows(g, "t", "c", "n") == [("d1", "a", 1), ("d1", "b", 0), ("d2", "a", 0), ("d2", "b", 5)]
    r = series.dense_running_total(df, "c", "t", "n")
    assert rows(r, "c", "t", "cumulative") == [("a", "d1", 1), ("a", "d2", 1), ("b", "d1", 0), ("b", "d2", 5)]


def test_range_summary_empty_is_zero(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 5.0), (D(2024, 1, 31), 8.0)], "d date, v double")
    r = aggs.range_summary(df, "d", "v", "2025-01-01", "2025-12-31").first()
    assert (r["current"], r["net_change"], r["monthly_avg"]) == (0.0, 0.0, 0.0)
    r = aggs.range_summary(df, "d", "v").first()
    assert (r["current"], r["net_change"], r["monthly_avg"]) == (8.0, 3.0, 45.0)


def test_chunk_range_single_day_and_tail(spark):
    b = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 1), D(2024, 4, 5))], "s date, e date")
    got = rows(loads.chunk_range(b, "s", "e", 90), "chunk_start", "chunk_end")
    assert got == [(D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 1), D(2024, 3, 30)), (D(2024, 3, 31), D(2024, 4, 5))]


def test_human_count_format(spark):
    df = spark.createDataFrame([(596,), (1000,), (2514,), (244320,), (55602998,)], "n long")
    assert [r[0] for r in df.select(loads.human_count("n")).collect()] == ["596", "1.0K", "2.5K", "244.3K", "55.6M"]


def test_rate_of_change_needs_full_window(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(31)], "i int, v double")
    got = series.rate_of_change(df, None, "i", "v", 30).collect()
    assert len(got) == 1 and got[0]["i"] == 15 and got[0]["rate"] == pytest.approx((30 * 30 - 0) / 30 * 30)
    assert series.rate_of_change(df.filter("i < 30"), None, "i", "v", 30).count() == 0


def test_guarded_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(aggs.guarded_ratio("a", "b", 1)).collect()] == [0.0, 33.3, 0.0]


def test_month_boundary_change_uses_previous_row(spark):
    df = spark.createDataFrame([(D(2024, 1, 30), 10.0), (D(2024, 1, 31), 12.0), (D(2024, 2, 2), 15.0), (D(2024, 2, 9), 1.0)],
                               "d date, v double")
    assert rows(series.month_boundary_change(df, None, "d", "v"), "month", "change", "area") == [(D(2024, 2, 1), 3.0, 15.0)]


def test_crosswalk_select_maps_excludes_includes_and_maps_back(spark):
    xw = spark.createDataFrame([("United States", "USA"), ("Turkiye", "Türkiye")], "a string, b string")
    target = spark.createDataFrame([("USA", 1), ("Türkiye", 2), ("Germany", 3), ("Russia", 4), ("France", 5)], "country string, v int")
    out = clean.name_crosswalk_select(target, "country", ["United States", "Turkiye", "Germany", "EU"], xw, "a", "b",
                                      exclude=["EU"], include=["Russia"])
    assert rows(out, "country", "v") == [("Germany", 3), ("Russia", 4), ("Turkiye", 2), ("United States", 1)]


def test_lenient_date_filter_keeps_years_and_garbage(spark):
    txt = spark.createDataFrame([("2024-03",), ("2024-05-02",), ("junk",), (None,), ("2023-12-31",)], "d string")
    got = sorted((r[0] or "") for r in clean.filter_date_range(txt, "d", "2024-01-01", "2024-03-31", keep_unparseable=True).collect())
    assert got == ["", "2024-03", "junk"]
    years = spark.createDataFrame([(2021,), (2024,)], "d int")
    assert clean.filter_date_range(years, "d", "2024-01-01", "2024-03-31", keep_unparseable=True).count() == 2


def test_full_outer_daily_null_dates_never_match(spark):
    a = spark.createDataFrame([(D(2024, 1, 1), 1), (None, 2)], "d date, x long")
    b = spark.createDataFrame([(D(2024, 1, 2), 5), (None, 7)], "d date, y long")
    got = sorted(rows(joins.full_outer_daily(a, b, "d")), key=lambda r: (r[0] is None, r[0] or D(1, 1, 1), r[1], r[2]))
    assert got == [(D(2024, 1, 1), 1, 0), (D(2024, 1, 2), 0, 5), (None, 0, 7), (None, 2, 0)]
