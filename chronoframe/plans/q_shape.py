"""Driver queries for sorts / top-k (T), set operations (U) and reshaping (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import aggs, shape
from chronoframe.plans.common import dsum, events, lineitem, orders, query, table
from chronoframe.plans.q_aggs import SQL_PAIR_STATS_R, _pair_stats_r
from chronoframe.operators import joins

STATUSES = ["F", "O", "P"]
EVENT_TYPES_ALL = ["click", "error", "purchase", "signup", "view"]


@query("T01_order_by", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od, o_orderpriority FROM orders
ORDER BY od DESC NULLS FIRST, o_orderpriority ASC NULLS LAST, o_orderkey ASC
""")
def t01(spark, sf):
    """Whole orders table ordered by date desc, priority, key (explicit NULL placement)."""
    o = orders(spark, sf).select("o_orderkey", "od", "o_orderpriority")
    return shape.order_by(o, [("od", "desc", "first"), ("o_orderpriority", "asc", "last"), ("o_orderkey", "asc", "last")])


@query("T02_nulls_last", """
SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status, o_totalprice FROM orders
ORDER BY status ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 20
""")
def t02(spark, sf):
    """NULLS LAST placement decides which rows survive a LIMIT."""
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"), "o_totalprice")
    return shape.top_k(o, [("status", "asc", "last"), ("o_totalprice", "desc", "last")], 20, tie=["o_orderkey"])


SQL_CUSTOMER_REVENUE = """SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS n
FROM orders GROUP BY 1"""


def _customer_revenue(spark, sf):
    return orders(spark, sf).groupBy("o_custkey").agg(F.sum("price").cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("T03_top_k", f"SELECT * FROM ({SQL_CUSTOMER_REVENUE}) ORDER BY revenue DESC, o_custkey LIMIT 10")
def t03(spark, sf):
    """Top 10 customers by revenue (key as tie-break)."""
    return shape.top_k(_customer_revenue(spark, sf), [("revenue", "desc", "last")], 10, tie=["o_custkey"])


@query("T04_order_by_expr", f"""
WITH ps AS ({SQL_PAIR_STATS_R})
SELECT a.src, a.dst, a.n AS n_ab, a.avg AS avg_ab, b.n AS n_ba, b.avg AS avg_ba
FROM ps a JOIN ps b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
ORDER BY abs(a.avg - b.avg) DESC, a.src, a.dst LIMIT 25
""")
def t04(spark, sf):
    """Pairs ordered by an expression (|avg_ab − avg_ba|), top 25."""
    j = joins.inverse_pair_join(_pair_stats_r(spark, sf), "src", "dst", ["n", "avg"])
    return shape.order_by_expr(j, F.abs(F.col("avg_ab") - F.col("avg_ba")), 25, tie=["src", "dst"])


SQL_NAME_QTY = """SELECT p_name, SUM(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""


@query("T05_top_k_resorted", f"SELECT * FROM ({SQL_NAME_QTY}) ORDER BY qty DESC, p_name LIMIT 10")
def t05(spark, sf):
    """Top 10 part names by quantity, then re-sorted alphabetically."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    g = li.groupBy("p_name").agg(F.sum("l_quantity").alias("qty"))
    return shape.top_k_resorted(g, "qty", 10, "p_name")


@query("T06_priority_sort", """
SELECT s_suppkey, s_name, CASE s_name WHEN 'Supplier#000000007' THEN 0 WHEN 'Supplier#000000002' THEN 1 ELSE 2 END AS priority
FROM supplier ORDER BY priority, s_name
""")
def t06(spark, sf):
    """Pinned suppliers first (in pinned order), then alphabetical."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return shape.priority_sort(s, "s_name", ["Supplier#000000007", "Supplier#000000002"])


SQL_NATION_STATUS = """SELECT n.n_name AS nation, o.o_orderstatus AS status, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2"""


def _nation_status(spark, sf):
    o = orders(spark, sf).join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    o = o.join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return o.groupBy(F.col("n_name").alias("nation"), F.col("o_orderstatus").alias("status")).agg(F.sum("price").alias("revenue"))


@query("T07_top_groups_stacked", f"""
WITH w AS (SELECT nation, """ + ", ".join(f"COALESCE(SUM(revenue) FILTER (WHERE status = '{s}'), 0) AS {s}" for s in STATUSES) + f"""
  FROM ({SQL_NATION_STATUS}) GROUP BY 1)
SELECT nation, """ + ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in STATUSES) + """, CAST(""" + " + ".join(STATUSES) + """ AS DOUBLE) AS total
FROM w ORDER BY """ + " + ".join(STATUSES) + """ DESC, nation LIMIT 20
""")
def t07(spark, sf):
    """Nations ranked by revenue across statuses, top 20, per-status columns kept."""
    r = shape.top_groups_stacked(_nation_status(spark, sf), "nation", "status", "revenue", STATUSES, 20)
    return r.select("nation", *[F.col(s).cast("double").alias(s) for s in STATUSES], F.col("total").cast("double").alias("total"))


@query("U01_union_all_tagged", """
SELECT 'orders' AS source, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 2
UNION ALL SELECT 'lineitem', CAST(date_trunc('month', l_shipdate) AS DATE), COUNT(*), SUM(l_quantity) FROM lineitem GROUP BY 2
UNION ALL SELECT 'events', CAST(date_trunc('month', ts) AS DATE), COUNT(*), 0 FROM events GROUP BY 2
""")
def u01(spark, sf):
    """Three monthly rollups unioned with a literal tag; the missing measure is 0."""
    o = aggs.bucket_count(orders(spark, sf), "od", "month", aggs={"amount": dsum("o_totalprice")}, count="n")
    li = aggs.bucket_count(lineitem(spark, sf), "sd", "month", aggs={"amount": F.sum("l_quantity")}, count="n")
    e = aggs.bucket_count(events(spark, sf), "d", "month", count="n")
    r = shape.union_all_tagged({"orders": o, "lineitem": li, "events": e}, ["month", "n", "amount"], defaults={"amount": 0.0})
    return r


@query("U02_append_rows", """
SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT 'ALL', COUNT(*) FROM orders
""")
def u02(spark, sf):
    """Per-status counts with a computed total row appended."""
    o = table(spark, sf, "orders")
    per = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    tot = o.agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("ALL"))
    return shape.append_rows(per, tot)


@query("U03_distinct_values", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS od FROM orders ORDER BY od")
def u03(spark, sf):
    """Distinct order days, sorted."""
    return shape.distinct_values(orders(spark, sf), ["od"])


@query("U04_overlay_by_key", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal <= 5000
UNION ALL SELECT c_custkey, c_name, c_acctbal + 100 FROM customer WHERE c_acctbal > 5000
""")
def u04(spark, sf):
    """A fresh record set replaces the static one key by key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = c.filter(F.col("c_acctbal") > 5000).withColumn("c_acctbal", F.col("c_acctbal") + 100)
    return shape.overlay_by_key([c, fresh], "c_custkey")


@query("U04_overlay_by_key_sets", """
WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) < 2001),
b AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) >= 2001 AND o_orderstatus = 'F'),
c AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey, -o_totalprice AS o_totalprice
  FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM c UNION ALL
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey IS NOT DISTINCT FROM b.o_custkey) UNION ALL
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey IS NOT DISTINCT FROM a.o_custkey)
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey IS NOT DISTINCT FROM a.o_custkey)
""")
def u04_sets(spark, sf):
    """Record sets of three frames: all orders of a customer from the last frame that has the customer."""
    o = table(spark, sf, "orders")
    cols = ["o_custkey", "o_orderkey", "o_totalprice"]
    year, status = F.year("o_orderdate"), F.col("o_orderstatus")
    last = o.filter(status == "P").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"),
                                          "o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    frames = [o.filter(year < 2001).select(*cols), o.filter((year >= 2001) & (status == "F")).select(*cols), last]
    return shape.overlay_by_key(frames, "o_custkey")


SQL_MONTH_STATUS = ("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, " + ", ".join(
    f"COUNT(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in STATUSES) + " FROM orders GROUP BY 1")


def _month_status(spark, sf):
    o = orders(spark, sf).withColumn("month", F.trunc("od", "month")).withColumn("one", F.lit(1))
    return shape.pivot_sum(o, "month", "o_orderstatus", "one", STATUSES)


@query("R01_pivot_sum", SQL_MONTH_STATUS)
def r01(spark, sf):
    """Month × status counts, one column per (listed) status, absent = 0."""
    r = _month_status(spark, sf)
    return r.select("month", *[F.col(s).cast("long").alias(s) for s in STATUSES])


@query("R02_dense_grid", """
WITH r AS (SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n FROM events WHERE value > 230 GROUP BY 1, 2)
SELECT g.d, g.event_type, COALESCE(r.n, 0) AS n
FROM (SELECT DISTINCT d FROM r) g0 CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type) t
JOIN (SELECT DISTINCT d FROM r) g ON g.d = g0.d
LEFT JOIN r ON r.d = g.d AND r.event_type = t.event_type
""".replace("g.event_type", "t.event_type"))
def r02(spark, sf):
    """Every day of a sparse rollup × every listed type, 0 for gaps."""
    e = events(spark, sf).filter(F.col("value") > 230).withColumn("one", F.lit(1))
    return shape.dense_grid(e, "d", "event_type", "one", EVENT_TYPES_ALL).withColumnRenamed("one", "n") \
        .withColumn("n", F.col("n").cast("long"))


@query("R03_unpivot", f"""
SELECT month, status, n FROM ({SQL_MONTH_STATUS}) UNPIVOT (n FOR status IN ({', '.join(STATUSES)}))
""")
def r03(spark, sf):
    """The R01 wide table back to long form."""
    r = _month_status(spark, sf).select("month", *[F.col(s).cast("long").alias(s) for s in STATUSES])
    return shape.unpivot(r, ["month"], STATUSES, "status", "n")


@query("R04_transpose_scores", """
WITH top AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS part, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
               CAST(p_size AS DOUBLE) * p_retailprice AS score
             FROM part ORDER BY p_retailprice DESC, part LIMIT 5),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, part) AS rk FROM top),
long AS (SELECT part, rk, 'p_size' AS metric, p_size AS v FROM ranked
         UNION ALL SELECT part, rk, 'p_retailprice', p_retailprice FROM ranked
         UNION ALL SELECT part, rk, 'score', score FROM ranked)
SELECT metric, MAX(part) FILTER (WHERE rk = 1) AS name_1, MAX(v) FILTER (WHERE rk = 1) AS value_1,
  MAX(part) FILTER (WHERE rk = 2) AS name_2, MAX(v) FILTER (WHERE rk = 2) AS value_2,
  MAX(part) FILTER (WHERE rk = 3) AS name_3, MAX(v) FILTER (WHERE rk = 3) AS value_3,
  MAX(part) FILTER (WHERE rk = 4) AS name_4, MAX(v) FILTER (WHERE rk = 4) AS value_4,
  MAX(part) FILTER (WHERE rk = 5) AS name_5, MAX(v) FILTER (WHERE rk = 5) AS value_5
FROM long GROUP BY metric
""")
def r04(spark, sf):
    """Metrics as rows, the top-5 parts by price as columns."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part"),
                                        F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
                                        (F.col("p_size").cast("double") * F.col("p_retailprice")).alias("score"))
    return shape.transpose_scores(p, "part", ["p_size", "p_retailprice", "score"], "p_retailprice", 5)


@query("R05_selected_total", """
SELECT sd, launched, destroyed, launched + destroyed AS total FROM (
  SELECT CAST(l_shipdate AS DATE) AS sd, SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS launched,
         SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS destroyed
  FROM lineitem GROUP BY 1) WHERE launched + destroyed > 0
""")
def r05(spark, sf):
    """Sum of the enabled measure groups per row; rows with total ≤ 0 dropped, sorted by total."""
    li = lineitem(spark, sf)
    o = F.col("l_linestatus") == "O"
    r = aggs.conditional_sums(li, "sd", {"launched": (o, "l_quantity"), "destroyed": (o & (F.col("l_returnflag") == "R"), "l_quantity")})
    return shape.selected_total(r, {"launch": ["launched"], "kill": ["destroyed"]}, ["launch", "kill"], order="sd")


@query("R06_funding_gap", """
SELECT o.o_orderkey, o.o_totalprice, COALESCE(f.funded, 0) AS funded, o.o_totalprice - COALESCE(f.funded, 0) AS gap,
  COALESCE(f.funded, 0) / o.o_totalprice * 100.0 AS pct_funded
FROM orders o LEFT JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS funded
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) f ON o.o_orderkey = f.l_orderkey
WHERE o.o_totalprice > 0
""")
def r06(spark, sf):
    """Requirement vs funded per order (non-returned line value): gap and % funded."""
    f = table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "R").groupBy(F.col("l_orderkey").alias("o_orderkey")) \
        .agg(dsum("l_extendedprice").alias("funded"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(f, "o_orderkey", "left")
    return shape.funding_gap(o, "o_totalprice", "funded").withColumn("funded", F.coalesce("funded", F.lit(0.0)))
