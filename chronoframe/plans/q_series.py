"""Driver queries for ordered time-series operators.

Inputs are daily rollups (one row per series and day), the shape the
reference's client code receives; windows partition by the series key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import series
from chronoframe.plans.common import (
    SQL_DAILY_EVENTS_BY_TYPE, SQL_DAILY_ORDERS, SQL_DAILY_ORDERS_BY_PRIORITY, SQL_DAILY_QTY, SQL_RUNNING_QTY,
    SQL_RUNNING_QTY_FLAG, daily_events_by_type, daily_orders, daily_orders_by_priority, daily_qty, events,
    lineitem, orders, query, running_qty, table,
)
from chronoframe.plans.q_aggs import EVENT_TYPES, _merged_daily_types
from chronoframe.plans.q_joins import SQL_NATION_YEAR_REVENUE

UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("W01_diff_lag1", f"""
SELECT l_returnflag, sd, total, total - lag(total) OVER (PARTITION BY l_returnflag ORDER BY sd) AS total_diff
FROM ({SQL_RUNNING_QTY_FLAG}) QUALIFY total_diff IS NOT NULL
""")
def w01(spark, sf):
    """Cumulative counter → daily flow per series (first row dropped)."""
    r = running_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "total")
    return series.diff_lag1(r, "l_returnflag", "sd", ["total"])


SQL_SPARSE_TYPES = "SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n FROM events WHERE value > 200 GROUP BY 1, 2"
SELECTED = ["click", "error", "view"]


@query("W02_pivot_diff", f"""
WITH r AS ({SQL_SPARSE_TYPES}),
w AS (SELECT d, """ + ", ".join(f"CAST(COALESCE(SUM(n) FILTER (WHERE event_type = '{t}'), 0) AS BIGINT) AS {t}" for t in SELECTED) + """
      FROM r GROUP BY d)
SELECT d, """ + ", ".join(f"{t} - lag({t}) OVER (ORDER BY d) AS {t}" for t in SELECTED) + """
FROM w QUALIFY row_number() OVER (ORDER BY d) > 1
""")
def w02(spark, sf):
    """Day-over-day change per selected type on the grid of all days, a missing cell counting 0."""
    e = events(spark, sf).filter(F.col("value") > 200).groupBy("d", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return series.pivot_diff(e, "event_type", "d", "n", SELECTED)


@query("W03_trailing_mean", f"""
SELECT o_orderpriority, od, n_orders,
  AVG(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY od ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg,
  floor(AVG(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY od ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 0.5) AS avg_js
FROM ({SQL_DAILY_ORDERS_BY_PRIORITY})
""")
def w03(spark, sf):
    """7-row trailing mean over the actual window size, plus its Math.round form."""
    d = daily_orders_by_priority(spark, sf)
    d = series.trailing_mean(d, "o_orderpriority", "od", "n_orders", 7, out="avg")
    return series.trailing_mean(d, "o_orderpriority", "od", "n_orders", 7, js_round=True, out="avg_js")


@query("W03_trailing_mean_weekly", f"""
WITH RECURSIVE s AS (SELECT o_orderpriority AS k, od, CAST(n_orders AS DOUBLE) AS v, od + 7 AS due
                     FROM ({SQL_DAILY_ORDERS_BY_PRIORITY})),
nxt AS MATERIALIZED (SELECT a.k, a.od, b.od AS nd, b.v AS nv FROM s a ASOF JOIN s b ON a.k = b.k AND a.due <= b.od),
r AS (SELECT k, od, v, CAST(NULL AS DOUBLE) AS change, false AS emit FROM s
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY od) = 1
      UNION ALL
      SELECT r.k, n.nd, n.nv, n.nv - r.v, true FROM r JOIN nxt n ON n.k = r.k AND n.od = r.od)
SELECT k AS o_orderpriority, od, change, v AS n_orders,
  AVG(change) OVER (PARTITION BY k ORDER BY od ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS avg_change
FROM r WHERE emit
""")
def w03_weekly(spark, sf):
    """Weekly (greedy 7-day anchored) changes smoothed by a 4-period trailing mean, per series."""
    weekly = series.week_anchor_change(daily_orders_by_priority(spark, sf), "o_orderpriority", "od", "n_orders", 7)
    return series.trailing_mean(weekly, "o_orderpriority", "od", "change", 4, out="avg_change")


@query("W04_prior_mean", f"""
SELECT event_type, d, n, round(SUM(n) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / 7.0, 2)
  AS rolling_avg
FROM ({SQL_DAILY_EVENTS_BY_TYPE}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY d) > 7
""")
def w04(spark, sf):
    """Mean of the 7 rows before (fixed divisor 7), first 7 rows dropped, 2 decimals."""
    return series.prior_mean(daily_events_by_type(spark, sf), "event_type", "d", "n", 7)


@query("W05_pct_change_k", f"""
SELECT o_orderpriority, od, n_orders, CASE WHEN prev > 0 THEN (n_orders - prev) / prev * 100.0 ELSE 0 END AS rate FROM (
  SELECT *, lag(n_orders, 7) OVER (PARTITION BY o_orderpriority ORDER BY od) AS prev FROM ({SQL_DAILY_ORDERS_BY_PRIORITY}))
WHERE prev IS NOT NULL
""")
def w05(spark, sf):
    """Change vs 7 rows back in %, 0 when that value is ≤ 0; first 7 rows dropped."""
    return series.pct_change_k(daily_orders_by_priority(spark, sf), "o_orderpriority", "od", "n_orders", 7)


SQL_SPARSE_QTY = """SELECT CAST(l_shipdate AS DATE) AS sd, SUM(l_quantity) AS qty FROM lineitem
WHERE l_returnflag = 'R' AND l_discount >= 0.09 GROUP BY 1"""


@query("W05_pct_change_k_recent", f"""
SELECT od, n_orders, CASE WHEN prev > 0 THEN (n_orders - prev) / prev * 100.0 ELSE 0 END AS rate FROM (
  SELECT *, lag(n_orders, 7) OVER (ORDER BY od) AS prev FROM (
    SELECT od, n_orders FROM ({SQL_DAILY_ORDERS}) ORDER BY od DESC LIMIT 365))
WHERE prev IS NOT NULL
""")
def w05_recent(spark, sf):
    """The newest 365 days first (top-k), then the change vs 7 rows back — the rate chart's composition."""
    recent = series.tail_n(daily_orders(spark, sf).select("od", "n_orders"), "od", 365)
    return series.pct_change_k(recent, None, "od", "n_orders", 7)


@query("W06_pct_change_clipped", f"""
SELECT sd, qty, greatest(-500, least(500, CASE WHEN prev > 0 THEN (qty - prev) / prev * 100.0 ELSE 0 END)) AS rate FROM (
  SELECT *, lag(qty, 6) OVER (ORDER BY sd) AS prev FROM ({SQL_SPARSE_QTY})) WHERE prev IS NOT NULL
""")
def w06(spark, sf):
    """6-row % change clamped to ±500 on a volatile daily series."""
    li = lineitem(spark, sf).filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09))
    d = li.groupBy("sd").agg(F.sum("l_quantity").alias("qty"))
    return series.pct_change_clipped(d, None, "sd", "qty", 6, 500.0)


@query("W07_running_total", f"""
WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT s.o_orderstatus, t.month FROM (SELECT DISTINCT o_orderstatus FROM m) s, (SELECT DISTINCT month FROM m) t)
SELECT g.month, g.o_orderstatus, COALESCE(m.n, 0) AS n,
  CAST(SUM(COALESCE(m.n, 0)) OVER (PARTITION BY g.o_orderstatus ORDER BY g.month {UPTO}) AS BIGINT) AS cumulative
FROM g LEFT JOIN m ON g.o_orderstatus = m.o_orderstatus AND g.month = m.month
""")
def w07(spark, sf):
    """Cumulative monthly orders per status on a dense month grid (absent months = 0)."""
    m = orders(spark, sf).groupBy("o_orderstatus", F.trunc("od", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return series.dense_running_total(m, "o_orderstatus", "month", "n")


@query("W08_since_start", f"""
SELECT l_returnflag, sd, total, total - first_value(total) OVER (PARTITION BY l_returnflag ORDER BY sd {UPTO}) AS since_start
FROM ({SQL_RUNNING_QTY_FLAG})
""")
def w08(spark, sf):
    """Running total minus its first value, per return flag."""
    r = running_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "total")
    return series.since_start(r, "l_returnflag", "sd", "total")


@query("W09_week_anchor_change", f"""
WITH RECURSIVE s AS (SELECT o_orderpriority AS k, od, CAST(n_orders AS DOUBLE) AS v, od + 7 AS due
                     FROM ({SQL_DAILY_ORDERS_BY_PRIORITY})),
nxt AS MATERIALIZED (SELECT a.k, a.od, b.od AS nd, b.v AS nv FROM s a ASOF JOIN s b ON a.k = b.k AND a.due <= b.od),
r AS (SELECT k, od, v, CAST(NULL AS DOUBLE) AS change, false AS emit FROM s
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY od) = 1
      UNION ALL
      SELECT r.k, n.nd, n.nv, n.nv - r.v, true FROM r JOIN nxt n ON n.k = r.k AND n.od = r.od)
SELECT k AS o_orderpriority, od, change, v AS n_orders FROM r WHERE emit
""")
def w09(spark, sf):
    """Greedy 7-day anchoring per series (sequential; applyInPandas per series)."""
    return series.week_anchor_change(daily_orders_by_priority(spark, sf), "o_orderpriority", "od", "n_orders", 7)


@query("W10_month_boundary_change", f"""
SELECT l_returnflag, CAST(date_trunc('month', sd) AS DATE) AS month, total - pv AS change, total AS area FROM (
  SELECT *, lag(total) OVER (PARTITION BY l_returnflag ORDER BY sd) AS pv,
    lag(strftime(sd, '%Y-%m')) OVER (PARTITION BY l_returnflag ORDER BY sd) AS pm FROM ({SQL_RUNNING_QTY_FLAG}))
WHERE pm IS NOT NULL AND pm <> strftime(sd, '%Y-%m')
""")
def w10(spark, sf):
    """At each month's first row: the change against the previous row (overnight change)."""
    r = running_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "total")
    return series.month_boundary_change(r, "l_returnflag", "sd", "total")


@query("W11_monthly_change", f"""
SELECT l_returnflag, month, last_total - lag(last_total) OVER (PARTITION BY l_returnflag ORDER BY month) AS change FROM (
  SELECT l_returnflag, strftime(sd, '%Y-%m') AS month, arg_max(total, sd) AS last_total FROM ({SQL_RUNNING_QTY_FLAG}) GROUP BY 1, 2)
QUALIFY change IS NOT NULL
""")
def w11(spark, sf):
    """End-of-month value minus the previous present month's end value."""
    r = running_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "total")
    return series.monthly_change(r, "l_returnflag", "sd", "total")


# a counter with gaps: NULL on Sundays and on the last day of every even month
SQL_GAPS = f"""SELECT l_returnflag, sd, CASE WHEN dayofweek(sd) = 0 OR (sd = last_day(sd) AND month(sd) % 2 = 0) THEN NULL
  ELSE total END AS total FROM ({SQL_RUNNING_QTY_FLAG})"""


def _gaps(spark, sf):
    r = running_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "total")
    missing = (F.dayofweek("sd") == 1) | ((F.col("sd") == F.last_day("sd")) & (F.month("sd") % 2 == 0))
    return r.withColumn("total", F.when(~missing, F.col("total")))


@query("W11_monthly_change_gaps", f"""
SELECT l_returnflag, month, last_total - lag(last_total) OVER (PARTITION BY l_returnflag ORDER BY month) AS change FROM (
  SELECT l_returnflag, strftime(sd, '%Y-%m') AS month, total AS last_total FROM ({SQL_GAPS})
  QUALIFY row_number() OVER (PARTITION BY l_returnflag, strftime(sd, '%Y-%m') ORDER BY sd DESC) = 1)
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY month) > 1
""")
def w11_gaps(spark, sf):
    """Months that end on a missing value stay, with an unknown change."""
    return series.monthly_change(_gaps(spark, sf), "l_returnflag", "sd", "total")


def _held(spark, sf, by_flag=False):
    r = running_qty(spark, sf, by_flag)
    return r.withColumn("held", F.floor(F.col("total") / 10000) * 10000.0)


SQL_HELD = f"SELECT sd, floor(total / 10000) * 10000.0 AS held FROM ({SQL_RUNNING_QTY})"
SQL_HELD_FLAG = f"SELECT l_returnflag, sd, floor(total / 10000) * 10000.0 AS held FROM ({SQL_RUNNING_QTY_FLAG})"


def _interp_sql(base: str, part: str) -> str:
    pb = f"PARTITION BY {part} " if part else ""
    return f"""s AS (SELECT *, row_number() OVER ({pb}ORDER BY sd) - 1 AS i, count(*) OVER ({pb[:-1] if pb else ''}) AS n,
    lag(held) OVER ({pb}ORDER BY sd) AS pv FROM ({base})),
c AS (SELECT *, (i = 0 OR i = n - 1 OR abs(held - pv) > 0.5) AS cp FROM s),
f AS (SELECT *,
  last_value(CASE WHEN cp THEN i END IGNORE NULLS) OVER ({pb}ORDER BY sd {UPTO}) AS x0,
  last_value(CASE WHEN cp THEN held END IGNORE NULLS) OVER ({pb}ORDER BY sd {UPTO}) AS y0,
  first_value(CASE WHEN cp THEN i END IGNORE NULLS) OVER ({pb}ORDER BY sd ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x1,
  first_value(CASE WHEN cp THEN held END IGNORE NULLS) OVER ({pb}ORDER BY sd ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y1
  FROM c),
g AS (SELECT *, CASE WHEN n < 2 OR x1 IS NULL THEN held ELSE y0 + (y1 - y0) * (i - x0) / (x1 - x0) END AS interpolated FROM f)"""


@query("W12_step_interpolate", f"""
WITH {_interp_sql(SQL_HELD, '')}
SELECT sd, held, interpolated FROM g
""")
def w12(spark, sf):
    """A step-held running total turned into straight lines between change points (by row index)."""
    h = _held(spark, sf).select("sd", "held")
    return series.step_interpolate(h, None, "sd", "held", 0.5)


@query("W13_rolling_median", f"""
SELECT od, n_orders, list_sort(list(n_orders) OVER (ORDER BY od ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))[
  CAST(floor(count(*) OVER (ORDER BY od ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 2) AS BIGINT) + 1] AS smoothed
FROM ({SQL_DAILY_ORDERS})
""")
def w13(spark, sf):
    """Centred 7-row upper median (edges truncated)."""
    d = daily_orders(spark, sf).select("od", "n_orders")
    return series.rolling_median(d, None, "od", "n_orders", 7)


WIDE = "(PARTITION BY event_type ORDER BY d ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)"


@query("W13_rolling_median_wide", f"""
SELECT event_type, d, n, list_sort(list(n) OVER {WIDE})[CAST(floor(count(*) OVER {WIDE} / 2) AS BIGINT) + 1] AS smoothed
FROM (SELECT event_type, CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1, 2)
""")
def w13_wide(spark, sf):
    """Centred median of a year of rows per event type, over a sliding order-statistics list."""
    e = events(spark, sf).groupBy("event_type", "d").agg(F.count(F.lit(1)).alias("n"))
    return series.rolling_median(e, "event_type", "d", "n", 365)


@query("W14_rate_of_change", f"""
SELECT sd, total, (a - b) / 30.0 * 30.0 AS rate FROM (
  SELECT sd, total, lead(total, 15) OVER (ORDER BY sd) AS a, lag(total, 15) OVER (ORDER BY sd) AS b FROM ({SQL_RUNNING_QTY}))
WHERE a IS NOT NULL AND b IS NOT NULL
""")
def w14(spark, sf):
    """Centred 30-row mean daily change × 30, only where the full window exists."""
    r = running_qty(spark, sf).select("sd", "total")
    return series.rate_of_change(r, None, "sd", "total", 30)


@query("W14_rate_of_change_gaps", f"""
SELECT l_returnflag, sd, total, (a - b) / 30.0 * 30.0 AS rate FROM (
  SELECT *, lead(total, 15) OVER w AS a, lag(total, 15) OVER w AS b, row_number() OVER w AS i,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM ({SQL_GAPS}) WINDOW w AS (PARTITION BY l_returnflag ORDER BY sd))
WHERE i > 15 AND i <= n - 15
""")
def w14_gaps(spark, sf):
    """Rows whose window ends at a missing value stay, with an unknown rate."""
    return series.rate_of_change(_gaps(spark, sf), "l_returnflag", "sd", "total", 30)


@query("W15_change_points", f"""
WITH RECURSIVE s AS (SELECT o_orderpriority, od, CAST(n_orders AS DOUBLE) AS v,
                            row_number() OVER (PARTITION BY o_orderpriority ORDER BY od) AS rn
                     FROM ({SQL_DAILY_ORDERS_BY_PRIORITY})),
r AS (SELECT o_orderpriority, rn, od, v, v AS last, true AS emit FROM s WHERE rn = 1
      UNION ALL
      SELECT s.o_orderpriority, s.rn, s.od, s.v,
        CASE WHEN abs(s.v - r.last) > 1 OR r.last < 0 THEN s.v ELSE r.last END,
        abs(s.v - r.last) > 1 OR r.last < 0
      FROM r JOIN s ON s.o_orderpriority = r.o_orderpriority AND s.rn = r.rn + 1)
SELECT o_orderpriority, od, v AS n_orders FROM r WHERE emit
""")
def w15(spark, sf):
    """Per priority, days differing by > 1 from the last *emitted* value (sequential state; applyInPandas per series)."""
    d = daily_orders_by_priority(spark, sf).withColumn("n_orders", F.col("n_orders").cast("double"))
    return series.change_points(d, "o_orderpriority", "od", "n_orders", 1.0)


@query("W16_max_normalise", "WITH m AS (SELECT CAST(ts AS DATE) AS d, " + ", ".join(
    f"COUNT(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY 1) SELECT d, " + ", ".join(EVENT_TYPES) + ", " + ", ".join(
    f"{t} / greatest(CAST(max({t}) OVER () AS DOUBLE), 1.0) * 100.0 AS {t}_norm" for t in EVENT_TYPES) + " FROM m")
def w16(spark, sf):
    """Each merged series scaled to its own maximum (floor 1) × 100."""
    return series.max_normalise(_merged_daily_types(spark, sf), EVENT_TYPES)


@query("W17_layer_series", f"""
WITH {_interp_sql(f"SELECT sd, held FROM ({SQL_HELD_FLAG}) WHERE l_returnflag = 'R'", '')}
SELECT sd, held, interpolated,
  list_sort(list(interpolated) OVER (ORDER BY sd ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))[
    CAST(floor(count(*) OVER (ORDER BY sd ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 2) AS BIGINT) + 1] AS smoothed
FROM g
""")
def w17(spark, sf):
    """One layer: raw, step-interpolated and median-smoothed interpolation."""
    h = _held(spark, sf, by_flag=True).select("l_returnflag", "sd", "held")
    return series.layer_series(h, "l_returnflag", "R", "sd", "held").drop("l_returnflag")


@query("W18_tail_n", f"SELECT * FROM ({SQL_DAILY_ORDERS}) ORDER BY od DESC LIMIT 180")
def w18(spark, sf):
    """The newest 180 days (re-sorted ascending)."""
    return series.tail_n(daily_orders(spark, sf), "od", 180)


@query("W19_latest_per_series", f"""
WITH r AS ({SQL_SPARSE_TYPES})
SELECT t.event_type, CAST(COALESCE(SUM(r.n) FILTER (WHERE r.d = (SELECT max(d) FROM r)), 0) AS BIGINT) AS latest
FROM (SELECT DISTINCT event_type FROM r) t LEFT JOIN r ON t.event_type = r.event_type GROUP BY 1
""")
def w19(spark, sf):
    """Each type's value on the table's latest day (0 when the type is absent that day)."""
    e = events(spark, sf).filter(F.col("value") > 200).groupBy("d", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return series.latest_per_series(e, "event_type", "d", "n")


@query("W20_top_n_latest_year", f"""
SELECT * FROM ({SQL_NATION_YEAR_REVENUE}) WHERE year = (SELECT CAST(max(year(o_orderdate)) AS INTEGER) FROM orders)
ORDER BY revenue DESC, nation LIMIT 10
""")
def w20(spark, sf):
    """Top 10 nations by revenue in the latest year present."""
    n = table(spark, sf, "nation")
    o = orders(spark, sf).join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    rev = o.groupBy(F.col("n_name").alias("nation"), F.year("od").alias("year")).agg(F.sum("price").cast("double").alias("revenue"))
    return series.top_n_latest_year(rev, "year", "revenue", 10, tie="nation")
