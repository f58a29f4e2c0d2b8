"""Driver queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import joins
from chronoframe.plans.common import (
    SQL_DAILY_QTY, daily_events, daily_qty, dsum, events, lineitem, orders, query, sql_daily_events, table,
)
from chronoframe.plans.q_aggs import EVENT_TYPES, SQL_PAIR_STATS_R, _merged_daily_types, _pair_stats_r


@query("J01_full_outer_daily", f"""
WITH a AS (SELECT d, n AS clicks FROM ({sql_daily_events('click')})),
     b AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) AS big_purchases,
                  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS big_purchase_value
           FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY 1)
SELECT COALESCE(a.d, b.d) AS d, COALESCE(clicks, 0) AS clicks, COALESCE(big_purchases, 0) AS big_purchases,
       COALESCE(big_purchase_value, 0) AS big_purchase_value
FROM a FULL OUTER JOIN b ON a.d = b.d
""")
def j01(spark, sf):
    """Daily clicks vs daily large purchases, full outer on date, gaps → 0."""
    a = daily_events(spark, sf, "click").select("d", F.col("n").alias("clicks"))
    e = events(spark, sf).filter((F.col("event_type") == "purchase") & (F.col("value") > 40))
    b = e.groupBy("d").agg(F.count(F.lit(1)).alias("big_purchases"), dsum("value").alias("big_purchase_value"))
    return joins.full_outer_daily(a, b, "d")


@query("J02_full_outer_3way", """
WITH a AS (SELECT c_nationkey AS nk, COUNT(*) AS rich_customers FROM customer WHERE c_acctbal > 9900 GROUP BY 1),
     b AS (SELECT s_nationkey AS nk, COUNT(*) AS rich_suppliers FROM supplier WHERE s_acctbal > 8000 GROUP BY 1),
     c AS (SELECT c_nationkey AS nk, COUNT(*) AS big_orders FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_totalprice > 490000 GROUP BY 1)
SELECT COALESCE(a.nk, b.nk, c.nk) AS nk, rich_customers, rich_suppliers, big_orders
FROM a FULL OUTER JOIN b ON a.nk = b.nk FULL OUTER JOIN c ON COALESCE(a.nk, b.nk) = c.nk
""")
def j02(spark, sf):
    """Three per-nation rollups, each filtered differently; the third joins on the coalesced key; gaps stay NULL."""
    cu = table(spark, sf, "customer")
    a = cu.filter(F.col("c_acctbal") > 9900).groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("rich_customers"))
    b = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 8000).groupBy(F.col("s_nationkey").alias("nk")) \
        .agg(F.count(F.lit(1)).alias("rich_suppliers"))
    o = table(spark, sf, "orders").filter(F.col("o_totalprice") > 490000) \
        .join(cu.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    c = o.groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("big_orders"))
    return joins.full_outer_3way(a, b, c, "nk")


@query("J03_date_merge_fill", "SELECT CAST(ts AS DATE) AS d, " + ", ".join(
    f"COUNT(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    + " FROM events WHERE event_type IN (" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + ") GROUP BY 1")
def j03(spark, sf):
    """Four daily series of one table merged by date in one scan and a pivot, absent = 0."""
    return _merged_daily_types(spark, sf)


@query("J03_date_merge_fill_sources", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY 1),
     l AS (SELECT CAST(l_shipdate AS DATE) AS d, COUNT(*) AS n FROM lineitem GROUP BY 1),
     e AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1),
     days AS (SELECT d FROM o UNION SELECT d FROM l UNION SELECT d FROM e)
SELECT days.d, COALESCE(o.n, 0) AS orders, COALESCE(l.n, 0) AS shipments, COALESCE(e.n, 0) AS events
FROM days LEFT JOIN o ON days.d = o.d LEFT JOIN l ON days.d = l.d LEFT JOIN e ON days.d = e.d
""")
def j03_sources(spark, sf):
    """Daily series from three different tables merged by date (each table read once), absent = 0."""
    frames = {
        "orders": table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n")),
        "shipments": table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count(F.lit(1)).alias("n")),
        "events": table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n")),
    }
    return joins.date_merge_fill(frames, "d", "n")


@query("J04_inverse_pair_join", f"""
WITH ps AS ({SQL_PAIR_STATS_R})
SELECT a.src, a.dst, a.n AS n_ab, a.avg AS avg_ab, b.n AS n_ba, b.avg AS avg_ba
FROM ps a JOIN ps b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
""")
def j04(spark, sf):
    """Pair stats joined to their reverse direction; one-directional pairs drop out."""
    return joins.inverse_pair_join(_pair_stats_r(spark, sf), "src", "dst", ["n", "avg"])


@query("J05_left_enrich", f"""
SELECT a.sd, a.qty, COALESCE(b.ret_qty, 0) AS ret_qty, a.qty - COALESCE(b.ret_qty, 0) AS kept_qty
FROM ({SQL_DAILY_QTY}) a LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS sd, SUM(l_quantity) AS ret_qty FROM lineitem
  WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.09 GROUP BY 1) b ON a.sd = b.sd
""")
def j05(spark, sf):
    """Daily totals left-merged with a sparser daily part; missing part → 0; kept = total − part."""
    a = daily_qty(spark, sf).select("sd", "qty")
    li = lineitem(spark, sf).filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.09))
    b = li.groupBy("sd").agg(F.sum("l_quantity").alias("ret_qty"))
    return joins.left_enrich(a, b, "sd", {"ret_qty": 0.0}, {"kept_qty": ("qty", "ret_qty")})


SQL_NATION_YEAR_REVENUE = """SELECT n.n_name AS nation, CAST(year(o.o_orderdate) AS INTEGER) AS year,
  CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2"""
SQL_SUPPLY_LOOKUP = """SELECT n.n_name AS nation, CAST(year(l.l_shipdate) AS INTEGER) AS year,
  CASE WHEN n.n_name = 'NATION_5' THEN 0 ELSE CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) END AS supply
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE year(l.l_shipdate) < 2001 GROUP BY 1, 2"""


@query("J06_lookup_join", f"""
SELECT r.nation, r.year, r.revenue, k.supply, r.revenue * 100.0 / NULLIF(k.supply, 0) AS ratio
FROM ({SQL_NATION_YEAR_REVENUE}) r LEFT JOIN ({SQL_SUPPLY_LOOKUP}) k ON r.nation = k.nation AND r.year = k.year
""")
def j06(spark, sf):
    """(nation, year) lookup: missing or zero lookup → NULL ratio."""
    n = table(spark, sf, "nation")
    o = orders(spark, sf).join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    rev = o.groupBy(F.col("n_name").alias("nation"), F.year("od").alias("year")).agg(F.sum("price").cast("double").alias("revenue"))
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey") \
        .join(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").filter(F.year("l_shipdate") < 2001)
    sup = li.groupBy(F.col("n_name").alias("nation"), F.year("l_shipdate").alias("year")) \
        .agg(dsum("l_extendedprice").alias("supply"))
    sup = sup.withColumn("supply", F.when(F.col("nation") == "NATION_5", F.lit(0.0)).otherwise(F.col("supply")))
    return joins.lookup_join(rev, sup, ["nation", "year"], "revenue", "supply", "ratio", scale=100.0)


SQL_SHIP_QTY = """SELECT n.n_name AS nation, CAST(year(l.l_shipdate) AS INTEGER) AS year, l.l_orderkey, l.l_linenumber,
  CASE WHEN l.l_quantity = 1 THEN NULL ELSE l.l_quantity END AS qty
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey"""


@query("J06_lookup_join_last", f"""
SELECT r.nation, r.year, r.revenue, k.qty, r.revenue * 100.0 / NULLIF(k.qty, 0) AS ratio
FROM ({SQL_NATION_YEAR_REVENUE}) r LEFT JOIN (SELECT * FROM ({SQL_SHIP_QTY})
  QUALIFY row_number() OVER (PARTITION BY nation, year ORDER BY l_orderkey DESC, l_linenumber DESC) = 1) k
  ON r.nation = k.nation AND r.year = k.year
""")
def j06_last(spark, sf):
    """Every line is a lookup row: of the many for a (nation, year) the last one counts, also when it is NULL."""
    n = table(spark, sf, "nation")
    o = orders(spark, sf).join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    rev = o.groupBy(F.col("n_name").alias("nation"), F.year("od").alias("year")).agg(F.sum("price").cast("double").alias("revenue"))
    ship = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey") \
        .join(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    ship = ship.select(F.col("n_name").alias("nation"), F.year("l_shipdate").alias("year"),
                       F.struct("l_orderkey", "l_linenumber").alias("line"), F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("qty"))
    return joins.lookup_join(rev, ship, ["nation", "year"], "revenue", "qty", "ratio", scale=100.0, order="line")


@query("J07_anti_existing", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2001-01-01')
""")
def j07(spark, sf):
    """Customers not yet present in the 2001 order book (the insert-if-absent filter)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) \
        .select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_existing(c, o, "c_custkey")


@query("J08_near_events", """
SELECT p.d AS point_day, e.event_id, e.ed AS event_day
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) p
JOIN (SELECT event_id, CAST(ts AS DATE) AS ed FROM events WHERE event_type = 'error' AND value > 200) e
  ON abs(date_diff('day', p.d, e.ed)) < 3
""")
def j08(spark, sf):
    """Days × notable error events less than 3 days apart, via bin-explode range join."""
    e = table(spark, sf, "events")
    points = e.select(F.to_date("ts").alias("point_day")).distinct()
    ev = e.filter((F.col("event_type") == "error") & (F.col("value") > 200)).select("event_id", F.to_date("ts").alias("event_day"))
    return joins.near_events(points, ev, "point_day", "event_day", 3)


@query("J09_semi_selected", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)
""")
def j09(spark, sf):
    """Customers that placed an order above a threshold (semi join)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    sel = table(spark, sf, "orders").filter(F.col("o_totalprice") > 490000).select("o_custkey")
    return joins.semi_selected(c, sel, "c_custkey", "o_custkey")


@query("J10_coverage_table", """
SELECT 'events' AS dataset, COALESCE(CAST(MIN(CAST(ts AS DATE)) AS VARCHAR), 'N/A') AS start_date,
  COALESCE(CAST(MAX(CAST(ts AS DATE)) AS VARCHAR), 'N/A') AS end_date, COUNT(*) AS count FROM events
UNION ALL SELECT 'orders', COALESCE(CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR), 'N/A'),
  COALESCE(CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR), 'N/A'), COUNT(*) FROM orders
UNION ALL SELECT 'lineitem', COALESCE(CAST(MIN(CAST(l_shipdate AS DATE)) AS VARCHAR), 'N/A'),
  COALESCE(CAST(MAX(CAST(l_shipdate AS DATE)) AS VARCHAR), 'N/A'), COUNT(*) FROM lineitem
UNION ALL SELECT 'refunds', COALESCE(CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR), 'N/A'),
  COALESCE(CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR), 'N/A'), COUNT(*) FROM orders WHERE o_totalprice < 0
""")
def j10(spark, sf):
    """Per dataset start / end / count; an empty dataset shows N/A and 0."""
    o = table(spark, sf, "orders")
    return joins.coverage_table({"events": (table(spark, sf, "events"), "ts"), "orders": (o, "o_orderdate"),
                                 "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"),
                                 "refunds": (o.filter(F.col("o_totalprice") < 0), "o_orderdate")})
