"""Ordered-series operators vs plain-Python transcriptions of the semantics,
on many random series at once (one Spark job per operator, windows
partitioned by series)."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import aggs, series

N_SERIES = 60


def _make_series(seed: int = 7):
    rnd = random.Random(seed)
    data = {}
    for s in range(N_SERIES):
        n = rnd.choice([0, 1, 2, 3, 5, 8, 13, 21, 34, 40])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 20))
        level, rows = rnd.uniform(-50, 50), []
        for _ in range(n):
            if rnd.random() < 0.3:  # a step
                level += rnd.choice([-20, -10.5, -0.5, 0.5, 0.6, 10, 10.5, 25])
            rows.append((day, round(level + rnd.choice([0, 0, 0, 0.25, -0.25]), 2)))
            day += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 3, 7, 9]))
        data[f"s{s:02d}"] = rows
    return data


@pytest.fixture(scope="module")
def data():
    return _make_series()


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(k, d, v) for k, pts in data.items() for d, v in pts]
    return spark.createDataFrame(rows, "k string, d date, v double")


def _by_series(df, *cols):
    out = {}
    for r in df.orderBy("k", "d").collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in cols))
    return out


def _interp(vals, thr=0.5):
    n = len(vals)
    if n < 2:
        return list(vals)
    cps = [0] + [i for i in range(1, n) if abs(vals[i] - vals[i - 1]) > thr]
    if cps[-1] != n - 1:
        cps.append(n - 1)
    out = []
    for i in range(n):
        lo = max(c for c in cps if c <= i)
        later = [c for c in cps if c > i]
        if not later:
            out.append(vals[i])
            continue
        hi = later[0]
        y0, y1 = vals[lo], vals[hi]
        out.append(y0 + (y1 - y0) * (i - lo) / (hi - lo))
    return out


def test_step_interpolate(frame, data):
    got = _by_series(series.step_interpolate(frame, "k", "d", "v"), "interpolated")
    for k, pts in data.items():
        exp = _interp([v for _, v in pts])
        assert [g[0] for g in got.get(k, [])] == pytest.approx(exp), k


def test_rolling_median(frame, data):
    got = _by_series(series.rolling_median(frame, "k", "d", "v", 7), "smoothed")
    for k, pts in data.items():
        vals = [v for _, v in pts]
        exp = [sorted(vals[max(0, i - 3): i + 4])[len(vals[max(0, i - 3): i + 4]) // 2] for i in range(len(vals))]
        assert [g[0] for g in got.get(k, [])] == exp, k


def test_rate_of_change(frame, data):
    got = _by_series(series.rate_of_change(frame, "k", "d", "v", 10), "d", "rate")
    for k, pts in data.items():
        vals, half = [v for _, v in pts], 5
        exp = []
        for i in range(half, len(vals) - half):
            diffs = [vals[j] - vals[j - 1] for j in range(i - half + 1, i + half + 1)]
            exp.append((pts[i][0], sum(diffs) / len(diffs) * 30))
        g = got.get(k, [])
        assert [x[0] for x in g] == [e[0] for e in exp], k
        assert [x[1] for x in g] == pytest.approx([e[1] for e in exp]), k


def test_change_points(frame, data):
    got = _by_series(series.change_points(frame, "k", "d", "v", 10.0), "d")
    for k, pts in data.items():
        prev, exp = -1.0, []
        for d, v in pts:
            if abs(v - prev) > 10 or prev < 0:
                exp.append(d)
                prev = v
        assert [g[0] for g in got.get(k, [])] == exp, k


def test_week_anchor_change(frame, data):
    got = _by_series(series.week_anchor_change(frame, "k", "d", "v", 7), "d", "change")
    for k, pts in data.items():
        exp = []
        if pts:
            ad, av = pts[0]
            for d, v in pts:
                if (d - ad).days >= 7:
                    exp.append((d, v - av))
                    ad, av = d, v
        g = got.get(k, [])
        assert [x[0] for x in g] == [e[0] for e in exp], k
        assert [x[1] for x in g] == pytest.approx([e[1] for e in exp]), k


def test_monthly_change(frame, data):
    got = {}
    for r in series.monthly_change(frame, "k", "d", "v").collect():
        got.setdefault(r["k"], {})[r["month"]] = r["change"]
    for k, pts in data.items():
        last = {}
        for d, v in pts:
            last[d.strftime("%Y-%m")] = v
        months = sorted(last)
        exp = {m: last[m] - last[p] for p, m in zip(months, months[1:])}
        assert got.get(k, {}) == pytest.approx(exp), k


def test_prior_and_trailing_means_and_pct_change(frame, data):
    prior = _by_series(series.prior_mean(frame, "k", "d", "v", 7), "rolling_avg")
    trail = _by_series(series.trailing_mean(frame, "k", "d", "v", 4), "avg")
    pct = _by_series(series.pct_change_k(frame, "k", "d", "v", 3), "rate")
    for k, pts in data.items():
        vals = [v for _, v in pts]
        assert [g[0] for g in prior.get(k, [])] == pytest.approx(
            [round(sum(vals[i - 7:i]) / 7, 2) for i in range(7, len(vals))], abs=0.011), k
        assert [g[0] for g in trail.get(k, [])] == pytest.approx(
            [sum(vals[max(0, i - 3): i + 1]) / len(vals[max(0, i - 3): i + 1]) for i in range(len(vals))]), k
        assert [g[0] for g in pct.get(k, [])] == pytest.approx(
            [((vals[i] - vals[i - 3]) / vals[i - 3] * 100 if vals[i - 3] > 0 else 0.0) for i in range(3, len(vals))]), k


def test_linear_trend_per_series(frame, data):
    got = {}
    for r in aggs.linear_trend(frame, "d", "v", "k").collect():
        got[r["k"]] = (r["slope"], r["intercept"])
    for k, pts in data.items():
        vals = [v for _, v in pts]
        n = len(vals)
        if n == 0:
            assert k not in got
            continue
        if n < 2:
            exp = (0.0, vals[0])
        else:
            sx, sy = sum(range(n)), sum(vals)
            sxy, sxx = sum(i * v for i, v in enumerate(vals)), sum(i * i for i in range(n))
            slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
            exp = (slope, (sy - slope * sx) / n)
        assert got[k] == pytest.approx(exp), k


def test_pearson_period_and_range_summaries(spark, data, frame):
    two = frame.withColumn("w", F.col("v") * F.col("v") - 3 * F.col("v"))
    got_r = {r["k"]: r["r"] for r in aggs.pearson(two, "v", "w", keys="k").collect()}
    got_p = {r["k"]: r for r in aggs.period_summary(frame, "v", keys="k").collect()}
    got_rs = {r["k"]: r for r in aggs.range_summary(frame, "d", "v", keys="k").collect()}
    for k, pts in data.items():
        xs = [v for _, v in pts]
        ys = [v * v - 3 * v for v in xs]
        n = len(xs)
        if n == 0:
            continue
        sx, sy = sum(xs), sum(ys)
        num = n * sum(a * b for a, b in zip(xs, ys)) - sx * sy
        den = ((n * sum(a * a for a in xs) - sx * sx) * (n * sum(b * b for b in ys) - sy * sy)) ** 0.5
        assert got_r[k] == pytest.approx(num / den if den else 0.0, abs=1e-9), k
        p = got_p[k]
        assert (p["total_change"], p["max_gain"], p["max_loss"]) == pytest.approx((sum(xs), max(xs), min(xs)))
        assert (p["positive_periods"], p["negative_periods"]) == (sum(x > 0 for x in xs), sum(x < 0 for x in xs))
        rs = got_rs[k]
        assert (rs["current"], rs["net_change"], rs["monthly_avg"]) == pytest.approx((xs[-1], xs[-1] - xs[0], (xs[-1] - xs[0]) / n * 30))
