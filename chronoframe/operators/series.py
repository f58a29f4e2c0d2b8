"""Ordered time-series operators.

All frames are row-based (missing days are not inserted). Inputs are
rollups — one row per (series, date) — so windows are partitioned by the
series key when there is one, and a single series holds a calendar-sized
number of rows; no window sees raw events (asserted on every driver query's
plan in ``tests/test_plans.py``). Of the two inherently sequential operators
W09 is a fold over calendar blocks, and W15 runs Python, as ``applyInPandas``
per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from chronoframe.functions.common import as_col
from chronoframe.functions.numeric import clip as clip_expr
from chronoframe.functions.numeric import round_to
from chronoframe.operators.shape import dense_grid


SORTED_ROWS = 31  # rows of a window that are sorted anew for each row


def _keys(series) -> list:
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


def _w(series, order) -> Window:
    k = _keys(series)
    o = [order] if isinstance(order, (str, Column)) else list(order)
    return (Window.partitionBy(*k) if k else Window).orderBy(*o)


# W01
def diff_lag1(df: DataFrame, series, order: str, cols: Sequence[str], suffix: str = "_diff") -> DataFrame:
    """value − previous row (cumulative counter → flow); first row dropped,
    negative corrections kept."""
    w = _w(series, order)
    res = df.withColumns({**{f"{c}{suffix}": as_col(c) - F.lag(c, 1).over(w) for c in cols}, "__rn": F.row_number().over(w)})
    return res.filter(F.col("__rn") > 1).drop("__rn")  # the first row goes, rows beside a NULL stay


# W02
def pivot_diff(df: DataFrame, series: str, date: str, value: str, selected: Sequence[str]) -> DataFrame:
    """Per-series change on the grid of all dates of the table, a missing
    cell counting as 0; the first date is dropped. One row per date, a
    column per selected series — one aggregation over all rows gives both the
    date grid and the selected cells (a single pass over the input)."""
    sel = list(selected)
    grid = df.groupBy(date).agg(*[F.coalesce(F.sum(F.when(F.col(series) == s, as_col(value))), F.lit(0)).alias(s)
                                  for s in sel])
    w = Window.orderBy(date)  # one row per date of a rollup: calendar-sized
    res = grid.withColumns({s: F.col(s) - F.lag(s, 1).over(w) for s in sel}).withColumn("__rn", F.row_number().over(w))
    return res.filter(F.col("__rn") > 1).drop("__rn")


# W03
def trailing_mean(df: DataFrame, series, order: str, col: str, k: int = 7, js_round: bool = False,
                  out: str = "avg") -> DataFrame:
    """Mean of the current and up to k−1 previous rows, divided by the actual
    window size; optional ``Math.round``."""
    w = _w(series, order).rowsBetween(-(k - 1), 0)
    m = F.avg(col).over(w)
    return df.withColumn(out, round_to(m, 0, "js") if js_round else m)


# W04
def prior_mean(df: DataFrame, series, order: str, col: str, k: int = 7, out: str = "rolling_avg") -> DataFrame:
    """Mean of the k rows *before* the current one with a fixed divisor k;
    the first k rows dropped; 2 decimals."""
    w = _w(series, order)
    res = df.withColumn(out, F.round(F.sum(col).over(w.rowsBetween(-k, -1)) / float(k), 2)) \
        .withColumn("__rn", F.row_number().over(w))
    return res.filter(F.col("__rn") > k).drop("__rn")


# W05
def pct_change_k(df: DataFrame, series, order: str, col: str, k: int = 7, out: str = "rate") -> DataFrame:
    """``(x − x[−k]) / x[−k] × 100``, 0 when the lagged value is ≤ 0 or NULL; the
    first k rows are dropped."""
    w = _w(series, order)
    prev = F.lag(col, k).over(w)
    res = df.withColumns({"__prev": prev, "__rn": F.row_number().over(w)})
    rate = F.when(F.col("__prev") > 0, (as_col(col) - F.col("__prev")) / F.col("__prev") * 100.0).otherwise(F.lit(0.0))
    return res.filter(F.col("__rn") > k).withColumn(out, rate).drop("__prev", "__rn")


# W06
def pct_change_clipped(df: DataFrame, series, order: str, col: str, k: int = 6, bound: float = 500.0,
                       out: str = "rate") -> DataFrame:
    res = pct_change_k(df, series, order, col, k, out)
    return res.withColumn(out, clip_expr(out, -bound, bound))


# W07
def running_total(df: DataFrame, series, order: str, col: str, out: str = "cumulative") -> DataFrame:
    w = _w(series, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(col).over(w))


def dense_running_total(df: DataFrame, series: str, order: str, col: str, out: str = "cumulative") -> DataFrame:
    """Running total per type on a dense grid of all orders × types (absent = 0)."""
    return running_total(dense_grid(df, order, series, col), series, order, col, out)


# W08
def since_start(df: DataFrame, series, order: str, col: str, out: str = "since_start") -> DataFrame:
    w = _w(series, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, as_col(col) - F.first(col).over(w))


# W09
def week_anchor_change(df: DataFrame, series, date: str, value: str, days: int = 7, block_days: int = 512) -> DataFrame:
    """Greedy anchoring: the first row is the anchor; a row at least ``days``
    after the anchor is emitted with its change against the anchor and becomes
    the new anchor.

    The calendar is cut into blocks. What a block does depends on one number,
    the day from which a row is due, and that is one of the block's first
    ``days`` days: a fold over the block's rows answers each of them. These
    answers are chained along a series, one step a block, and a second fold
    emits the rows of every block at once. Blocks, not series, are the unit of
    work, so one long series without a key spans tasks. Of several rows on one
    date the least value counts; rows without a date are left out.
    """
    if dict(df.dtypes)[date] != "date":
        raise ValueError(f"{date} must be a date")
    k = _keys(series)
    v = as_col(value).cast("double")
    daily = df.filter(F.col(date).isNotNull()).groupBy(*k, F.unix_date(date).alias("__d")).agg(F.min(v).alias("__v"))
    block = F.floor(F.col("__d") / block_days).cast("int")
    blocks = daily.groupBy(*k, block.alias("__b")).agg(F.sort_array(F.collect_list(F.struct("__d", "__v"))).alias("__r"))

    def step(s: Column, r: Column) -> Column:
        return F.when(r["__d"] >= s["due"], F.struct((r["__d"] + days).alias("due"), r["__v"].alias("val"), F.lit(True).alias("moved"))
                      ).otherwise(s)

    def from_day(t: Column) -> Column:
        start = F.struct((F.col("__b") * block_days + t).alias("due"), F.lit(None).cast("double").alias("val"),
                         F.lit(False).alias("moved"))
        return F.aggregate("__r", start, step)

    answers = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), from_day)
    chain = blocks.select(*k, F.struct(F.col("__b").alias("b"), answers.alias("a")).alias("__x"),
                          F.element_at("__r", 1)["__d"].alias("__d0"))
    chain = (chain.groupBy(*k) if k else chain.groupBy()).agg(F.sort_array(F.collect_list("__x")).alias("__c"),
                                                             F.min("__d0").alias("__first"))
    entry = "array<struct<b:int,due:int,val:double>>"

    def along(s: Column, x: Column) -> Column:
        start = x["b"] * block_days
        due = F.greatest(s["due"], start)  # the first row is due at once: it is the first anchor, and not emitted
        got = F.get(x["a"], due - start)
        return F.struct(got["due"].alias("due"), F.when(got["moved"], got["val"]).otherwise(s["val"]).alias("val"),
                        F.concat(s["out"], F.array(F.struct(x["b"].alias("b"), due.alias("due"), s["val"].alias("val"))).cast(entry)
                                 ).alias("out"))

    begin = F.struct(F.lit(-(1 << 31)).cast("int").alias("due"), F.lit(None).cast("double").alias("val"),
                     F.array().cast(entry).alias("out"))
    entries = chain.filter(F.size("__c") > 0).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)], "__first",
                                                    F.explode(F.aggregate("__c", begin, along)["out"]).alias("__e"))
    same = F.col("__b") == F.col("__e.b")
    for i, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    emitted = "array<struct<d:int,change:double,v:double>>"

    def emit(s: Column, r: Column) -> Column:
        one = F.array(F.struct(r["__d"].alias("d"), (r["__v"] - s["val"]).alias("change"), r["__v"].alias("v"))).cast(emitted)
        return F.when(r["__d"] >= s["due"], F.struct((r["__d"] + days).alias("due"), r["__v"].alias("val"),
                                                     F.concat(s["out"], one).alias("out"))).otherwise(s)

    start = F.struct(F.col("__e.due").alias("due"), F.col("__e.val").alias("val"), F.array().cast(emitted).alias("out"))
    out = (blocks.join(entries, same).select(*k, "__first", F.explode(F.aggregate("__r", start, emit)["out"]).alias("__o"))
           .filter(F.col("__o.d") != F.col("__first")))
    return out.select(*k, F.date_from_unix_date("__o.d").alias(date), F.col("__o.change").alias("change"),
                      F.col("__o.v").alias(value))


# W10
def month_boundary_change(df: DataFrame, series, date: str, value: str) -> DataFrame:
    """At the first row of each new month: change vs the previous row and the
    row's value, dated the first of the month (the first month is skipped)."""
    w = _w(series, date)
    m = F.date_format(date, "yyyy-MM")
    res = df.withColumn("__m", m).withColumn("__pm", F.lag("__m").over(w)).withColumn("__pv", F.lag(value).over(w))
    res = res.filter(F.col("__pm").isNotNull() & (F.col("__m") != F.col("__pm")))
    return res.select(*_keys(series), F.trunc(F.col(date), "month").alias("month"),
                      (as_col(value) - F.col("__pv")).alias("change"), as_col(value).alias("area"))


# W11
def monthly_change(df: DataFrame, series, date: str, value: str) -> DataFrame:
    """Last value of a month − last value of the previous present month; the
    first month is dropped. A month whose last row holds NULL stays, with a
    NULL change, and so does the month behind it."""
    k = _keys(series)
    monthly = df.groupBy(*k, F.date_format(date, "yyyy-MM").alias("month")).agg(F.max_by(value, date).alias("__last"))
    w = _w(series, "month")
    res = monthly.withColumns({"change": F.col("__last") - F.lag("__last").over(w), "__rn": F.row_number().over(w)})
    return res.filter(F.col("__rn") > 1).drop("__last", "__rn")


# W12
def step_interpolate(df: DataFrame, series, order: str, value: str, threshold: float = 0.5,
                     out: str = "interpolated") -> DataFrame:
    """Change points (first, last and rows with |Δ| > threshold) joined by
    straight lines over the row index; series shorter than 2 rows pass through."""
    w = _w(series, order)
    k = _keys(series)
    wk = Window.partitionBy(*k) if k else Window.partitionBy()
    s = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(wk))
    v = as_col(value)
    cp = (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1) | (F.abs(v - F.lag(value).over(w)) > threshold)
    s = s.withColumn("__cp", cp)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # the next change point is the last one met from the other end: a growing frame, one step a row
    fwd = wk.orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__x0", F.last(F.when(F.col("__cp"), F.col("__i")), True).over(back)) \
        .withColumn("__y0", F.last(F.when(F.col("__cp"), v), True).over(back)) \
        .withColumn("__x1", F.last(F.when(F.col("__cp"), F.col("__i")), True).over(fwd)) \
        .withColumn("__y1", F.last(F.when(F.col("__cp"), v), True).over(fwd))
    lerp = F.col("__y0") + (F.col("__y1") - F.col("__y0")) * (F.col("__i") - F.col("__x0")) / (F.col("__x1") - F.col("__x0"))
    val = F.when((F.col("__n") < 2) | F.col("__x1").isNull(), v.cast("double")).otherwise(lerp)
    return s.withColumn(out, val).drop("__i", "__n", "__cp", "__x0", "__y0", "__x1", "__y1")


# W13
def rolling_median(df: DataFrame, series, order: str, value: str, window: int = 7, out: str = "smoothed") -> DataFrame:
    """Centred ±window//2 rows (edges truncated), *upper* median
    ``sorted[floor(n / 2)]`` — not the averaging median. NULL values are
    skipped. Windows of more than ``SORTED_ROWS`` rows slide over an
    order-statistics list (a step costs the logarithm of the window) in runs
    of rows, each with the rows around it, so a long series spans tasks."""
    half = window // 2
    if window > SORTED_ROWS:
        return _sliding_median(df, _keys(series), order, value, half, out)
    w = _w(series, order).rowsBetween(-half, half)
    arr = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn(out, F.element_at(arr, (F.floor(F.size(arr) / 2) + 1).cast("int")))


def _sliding_median(df: DataFrame, k: list, order, value: str, half: int, out: str) -> DataFrame:
    run = max(4 * half, 4096)
    numbered = df.withColumn("__i", F.row_number().over(_w(k, order)) - 1)
    own = F.floor(F.col("__i") / run)
    # a row also goes to the run in front of it and the run behind it where its window reaches there
    runs = F.array_distinct(F.array(F.greatest(F.floor((F.col("__i") - half) / run), F.lit(0)), own,
                                    F.floor((F.col("__i") + half) / run)))
    spread = numbered.select(*k, "__i", F.col(value).cast("double").alias("__x"), own.alias("__own"), F.explode(runs).alias("__run"))
    schema = StructType([*(spread.schema[c] for c in k), StructField("__i", IntegerType()), StructField("__m", DoubleType())])

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        # of n sorted values the position n / 2, rounded down: the higher of the two in the middle
        median = pdf["__x"].rolling(2 * half + 1, center=True, min_periods=1).quantile(0.5, interpolation="higher")
        res = pdf[[*k, "__i"]].assign(__m=median)
        return res[pdf["__own"] == pdf["__run"]]

    medians = spread.groupBy(*k, "__run").applyInPandas(slide, schema)
    same = numbered["__i"] == F.col("__j")
    for i, c in enumerate(k):
        same = same & numbered[c].eqNullSafe(F.col(f"__k{i}"))
    named = medians.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)], F.col("__i").alias("__j"), "__m")
    kind = dict(df.dtypes)[value]
    return numbered.join(named, same).withColumn(out, F.col("__m").cast(kind)).drop("__i", "__j", "__m", *[f"__k{i}" for i in range(len(k))])


# W14
def rate_of_change(df: DataFrame, series, order: str, value: str, window: int = 30, out: str = "rate") -> DataFrame:
    """Mean daily difference over ±window//2 rows × 30, only where the full
    window exists. The mean of differences telescopes to an end-point
    difference, so this is two offsets, not a window of lists. A row whose
    window ends at a NULL stays, with a NULL rate; a window of fewer than two
    rows has no differences, so its rates are NULL."""
    half = window // 2
    w = _w(series, order)
    ends = {"__a": F.lead(value, half).over(w), "__b": F.lag(value, half).over(w), "__i": F.row_number().over(w),
            "__left": F.lead(F.lit(1), half).over(w)}  # a literal: NULL only where the series has ended
    res = df.withColumns(ends).filter((F.col("__i") > half) & F.col("__left").isNotNull())
    rate = (F.col("__a") - F.col("__b")) / F.lit(float(2 * half) or None).cast("double") * 30.0
    return res.withColumn(out, rate).drop(*ends)


# W15
def change_points(df: DataFrame, series, order: str, value: str, threshold: float = 10.0) -> DataFrame:
    """Emit the first row, then every row whose value differs by more than
    ``threshold`` from the *last emitted* value (a negative last value always
    lets the next row through). Sequential state: ``applyInPandas`` per series."""
    k = _keys(series)
    src = df.select(*k, order, value)
    key_cols = k or ["__g"]
    if not k:
        src = src.withColumn("__g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort")
        vs = pdf[value].astype("float64").to_numpy()
        keep, prev = [], -1.0
        for i, x in enumerate(vs):
            if abs(x - prev) > threshold or prev < 0:
                keep.append(i)
                prev = x
        return pdf.iloc[keep]

    out = src.groupBy(*key_cols).applyInPandas(run, src.schema)
    return out if k else out.drop("__g")


# W16
def max_normalise(df: DataFrame, cols: Sequence[str], floor: float = 1.0, suffix: str = "_norm") -> DataFrame:
    """x / max(max(x), floor) × 100 per column; all maxima come from one
    aggregate attached as a single struct-valued scalar subquery."""
    maxima = df.select(F.struct(*[F.max(c).cast("double").alias(c) for c in cols])).scalar()
    return df.withColumns({f"{c}{suffix}": as_col(c) / F.greatest(F.coalesce(maxima[c], F.lit(floor)),
                                                                  F.lit(floor)) * 100.0 for c in cols})


# W17
def layer_series(df: DataFrame, series: str, name: str, date: str, value: str) -> DataFrame:
    """One series: raw, step-interpolated and median-smoothed interpolation."""
    one = df.filter(F.col(series) == name)
    interp = step_interpolate(one, series, date, value, out="interpolated")
    return rolling_median(interp, series, date, "interpolated", out="smoothed")


# W18
def tail_n(df: DataFrame, order, n: int, newest_first: bool = False) -> DataFrame:
    """Last n rows by order (top-k, then re-sorted)."""
    o = [order] if isinstance(order, str) else list(order)
    tail = df.orderBy(*[F.col(c).desc() for c in o]).limit(n)
    return tail if newest_first else tail.orderBy(*o)


# W19
def latest_per_series(df: DataFrame, series: str, date: str, value: str, out: str = "latest") -> DataFrame:
    """Each series' value on the *global* latest date (0 when absent there).

    The latest date is a one-row aggregate (a scalar subquery over the pruned
    date column); the sums are one hash aggregate per series, of any number."""
    top = df.select(F.max(date)).scalar()
    per = df.groupBy(series).agg(F.sum(F.when(F.col(date) == top, F.col(value))).alias(out))
    return per.select(series, F.coalesce(F.col(out), F.lit(0).cast(dict(per.dtypes)[out])).alias(out))


# W20
def top_n_latest_year(df: DataFrame, year: str, measure: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """Top n rows of the latest year present; that year is a one-row
    aggregate, so no task sees more than its share of the rows."""
    top = df.filter(F.col(year) == df.select(F.max(year)).scalar())
    order = [F.col(measure).desc()] + ([F.col(tie).asc()] if tie else [])
    return top.orderBy(*order).limit(n)
