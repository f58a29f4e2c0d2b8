"""Registry and shared inputs of the driver queries.

Each registered query is ``f(spark, sf_dir) -> DataFrame`` over the driver
tables; its DuckDB twin (when SQL can express it) is registered next to it.
Money and value columns are summed as DECIMAL(18,2) on both sides so the
sums are exact and the compared doubles are identical; averages are
``sum / count`` for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir.rstrip("/"))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dec(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def dsum(c) -> F.Column:
    """Exact sum of a 2-decimal measure, returned as double."""
    return F.sum(dec(c)).cast("double")


# -- Spark-side derived inputs ------------------------------------------------

def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("d", F.to_date("ts")).withColumn("v", dec("value"))


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("od", F.to_date("o_orderdate")).withColumn("price", dec("o_totalprice"))


def lineitem(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("sd", F.to_date("l_shipdate"))


def daily_events(spark, sf, event_type: str | None = None) -> DataFrame:
    e = events(spark, sf)
    if event_type:
        e = e.filter(F.col("event_type") == event_type)
    return e.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("v"))


def daily_events_by_type(spark, sf) -> DataFrame:
    return events(spark, sf).groupBy("event_type", "d").agg(F.count(F.lit(1)).alias("n"))


def daily_orders(spark, sf) -> DataFrame:
    return orders(spark, sf).groupBy("od").agg(F.count(F.lit(1)).alias("n_orders"),
                                               F.sum("price").cast("double").alias("revenue"))


def daily_orders_by_priority(spark, sf) -> DataFrame:
    return orders(spark, sf).groupBy("o_orderpriority", "od").agg(F.count(F.lit(1)).alias("n_orders"))


def daily_qty(spark, sf, by_flag: bool = False) -> DataFrame:
    keys = ["l_returnflag", "sd"] if by_flag else ["sd"]
    return lineitem(spark, sf).groupBy(*keys).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines"))


def running_qty(spark, sf, by_flag: bool = False) -> DataFrame:
    """Cumulative counter series (running daily shipped quantity)."""
    from chronoframe.operators.series import running_total
    return running_total(daily_qty(spark, sf, by_flag), "l_returnflag" if by_flag else None, "sd", "qty", "total")


# -- the same inputs as SQL CTE bodies -----------------------------------------

SQL_DAILY_ORDERS = ("SELECT CAST(o_orderdate AS DATE) AS od, COUNT(*) AS n_orders, "
                    "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1")
SQL_DAILY_ORDERS_BY_PRIORITY = ("SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS od, COUNT(*) AS n_orders "
                                "FROM orders GROUP BY 1, 2")
SQL_DAILY_QTY = "SELECT CAST(l_shipdate AS DATE) AS sd, SUM(l_quantity) AS qty, COUNT(*) AS n_lines FROM lineitem GROUP BY 1"
SQL_DAILY_QTY_FLAG = ("SELECT l_returnflag, CAST(l_shipdate AS DATE) AS sd, SUM(l_quantity) AS qty, COUNT(*) AS n_lines "
                      "FROM lineitem GROUP BY 1, 2")
SQL_RUNNING_QTY = (f"SELECT sd, qty, n_lines, SUM(qty) OVER (ORDER BY sd ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                   f"AS total FROM ({SQL_DAILY_QTY})")
SQL_RUNNING_QTY_FLAG = (f"SELECT l_returnflag, sd, qty, n_lines, SUM(qty) OVER (PARTITION BY l_returnflag ORDER BY sd "
                        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM ({SQL_DAILY_QTY_FLAG})")
SQL_DAILY_EVENTS_BY_TYPE = "SELECT event_type, CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1, 2"


def sql_daily_events(event_type: str | None = None) -> str:
    where = f" WHERE event_type = '{event_type}'" if event_type else ""
    return ("SELECT CAST(ts AS DATE) AS d, COUNT(*) AS n, "
            f"CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events{where} GROUP BY 1")


def trade_pairs(spark, sf) -> DataFrame:
    """Directed (customer nation → supplier nation) pairs, one per line item:
    the reference's actor1 → actor2 event shape. Fact ⋈ fact on the order key
    shuffles; dimensions are joined by the planner (statistics and AQE decide on
    a broadcast)."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity",
                                             "l_discount", "l_returnflag")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                          F.to_date("o_orderdate").alias("od"), "o_orderpriority")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").join(cn, "c_nationkey").join(sn, "s_nationkey")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "src", "dst", "od", "o_orderpriority", "l_quantity",
                    dec("l_discount").alias("disc"), "l_returnflag")


SQL_PAIRS = """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, cn.n_name AS src, sn.n_name AS dst,
  CAST(o.o_orderdate AS DATE) AS od, o.o_orderpriority, l.l_quantity, CAST(l.l_discount AS DECIMAL(18,2)) AS disc,
  l.l_returnflag
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey"""
