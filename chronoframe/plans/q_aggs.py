"""Driver queries for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import functions as fx
from chronoframe import sources
from chronoframe.operators import aggs, joins, series
from chronoframe.plans.common import (
    SQL_DAILY_ORDERS, SQL_DAILY_QTY, SQL_PAIRS, SQL_RUNNING_QTY, daily_orders, daily_qty, dec, dsum,
    events, lineitem, orders, query, running_qty, table, trade_pairs,
)
from chronoframe.plans.q_clean import SQL_DIRTY_BALANCE, SQL_LONG_SIDES, _dirty_balance, long_amounts

FOCAL = "NATION_3"
EVENT_TYPES = ["click", "view", "purchase", "error"]


@query("A01_table_stats", """
SELECT COUNT(*) AS count, MIN(CAST(o_orderdate AS DATE)) AS min_date, MAX(CAST(o_orderdate AS DATE)) AS max_date FROM orders
""")
def a01(spark, sf):
    """Order count with first and last order date, one pass."""
    return aggs.table_stats(orders(spark, sf), "od")


@query("A01_table_stats_footer", """
SELECT COUNT(*) AS count, MIN(l_orderkey) AS min_l_orderkey, MAX(l_orderkey) AS max_l_orderkey, MIN(l_quantity) AS min_l_quantity,
  MAX(l_quantity) AS max_l_quantity, MIN(l_returnflag) AS min_l_returnflag, MAX(l_returnflag) AS max_l_returnflag FROM lineitem
""")
def a01_footer(spark, sf):
    """Line item count and extremes: numbers from the file footers, text by a scan of its column."""
    return sources.footer_stats(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"])


@query("A02_table_count", "SELECT COUNT(*) AS count FROM lineitem")
def a02(spark, sf):
    """Line item count."""
    return aggs.table_count(table(spark, sf, "lineitem"))


@query("A03_global_sums", """
SELECT COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS days, COALESCE(SUM(l_quantity), 0) AS qty,
  CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue FROM lineitem
""")
def a03(spark, sf):
    """Distinct ship days and coalesced quantity / revenue sums over all line items."""
    li = lineitem(spark, sf).withColumn("ep", dec("l_extendedprice"))
    r = aggs.global_sums(li, "sd", {"qty": "l_quantity", "revenue": "ep"})
    return r.withColumn("revenue", F.col("revenue").cast("double"))


@query("A04_max_of_cumulative", f"SELECT COALESCE(MAX(total), 0) AS latest_total FROM ({SQL_RUNNING_QTY})")
def a04(spark, sf):
    """Latest value of a cumulative counter = its maximum."""
    return aggs.max_of_cumulative(running_qty(spark, sf), {"latest_total": "total"})


@query("A05_group_count_sum", """
SELECT NULLIF(o_orderstatus, 'P') AS status, o_orderpriority, COUNT(*) AS count,
  CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total,
  MIN(CAST(o_orderdate AS DATE)) AS first_date, MAX(CAST(o_orderdate AS DATE)) AS last_date
FROM orders GROUP BY 1, 2
""")
def a05(spark, sf):
    """Count, sum, first/last date by status × priority; the NULL status group is kept."""
    o = orders(spark, sf).withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    r = aggs.group_count_sum(o, ["status", "o_orderpriority"], "price", "od")
    return r.withColumn("total", F.col("total").cast("double"))


@query("A06_bucket_count", """
SELECT CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week, event_type, COUNT(*) AS count,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events GROUP BY 1, 2
""")
def a06(spark, sf):
    """Events per Monday-week × type: count and value."""
    return aggs.bucket_count(events(spark, sf), "ts", "week", ["event_type"], {"total_value": dsum("value")})


@query("A06_bucket_count_month", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, COUNT(*) AS count,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders GROUP BY 1, 2
""")
def a06_month(spark, sf):
    """Orders per month × status: count and revenue."""
    return aggs.bucket_count(orders(spark, sf), "o_orderdate", "month", ["o_orderstatus"], {"revenue": dsum("o_totalprice")})


@query("A06_bucket_count_day", """
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS count,
  COALESCE(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value), 0) AS avg_value
FROM events GROUP BY 1, 2
""")
def a06_day(spark, sf):
    """Events per day × type: count and average value."""
    return aggs.bucket_count(events(spark, sf), "ts", "day", ["event_type"], {"avg_value": F.coalesce(fx.mean("v"), F.lit(0.0))})


@query("A07_conditional_sums", """
SELECT CAST(l_shipdate AS DATE) AS sd, SUM(l_quantity) AS launched,
  SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS destroyed,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned_lines
FROM lineitem GROUP BY 1
""")
def a07(spark, sf):
    """Per ship day: total quantity, returned quantity and returned line count (CASE sums)."""
    li = lineitem(spark, sf)
    r = F.col("l_returnflag") == "R"
    return aggs.conditional_sums(li, "sd", {"launched": (F.lit(True), "l_quantity"), "destroyed": (r, "l_quantity"),
                                            "returned_lines": (r, 1)})


@query("A07_conditional_sums_threats", """
SELECT sd, CAST(COALESCE(SUM(launched), 0) AS BIGINT) AS total_launched,
  CAST(COALESCE(SUM(destroyed), 0) AS BIGINT) AS total_destroyed,
  CAST(COALESCE(SUM(flag_count), 0) AS BIGINT) AS drones_launched,
  CAST(COALESCE(SUM(CASE WHEN flag_count IS NOT NULL THEN destroyed ELSE 0 END), 0) AS BIGINT) AS drones_destroyed,
  CAST(COALESCE(SUM(CASE WHEN flag_count IS NULL THEN launched ELSE 0 END), 0) AS BIGINT) AS missiles_launched,
  CAST(COALESCE(SUM(CASE WHEN flag_count IS NULL THEN destroyed ELSE 0 END), 0) AS BIGINT) AS missiles_destroyed,
  COUNT(DISTINCT l_orderkey) AS attack_waves
FROM (SELECT CAST(l_shipdate AS DATE) AS sd, l_orderkey, l_quantity AS launched,
        CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS destroyed,
        CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS flag_count FROM lineitem)
GROUP BY 1
""")
def a07_threats(spark, sf):
    """Daily split by a count-in-flag column (a NULL flag means the other kind; when set, the flag
    itself is the count summed), plus distinct waves — one aggregation."""
    li = lineitem(spark, sf).select(
        "sd", "l_orderkey", F.col("l_quantity").alias("launched"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("destroyed"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("flag_count"))
    flag = F.col("flag_count").isNotNull()
    r = aggs.conditional_sums(li, "sd", {
        "total_launched": (F.lit(True), "launched"), "total_destroyed": (F.lit(True), "destroyed"),
        "drones_launched": (flag, "flag_count"), "drones_destroyed": (flag, "destroyed"),
        "missiles_launched": (~flag, "launched"), "missiles_destroyed": (~flag, "destroyed"),
    }, extra={"attack_waves": F.count_distinct("l_orderkey")})
    return r.select("sd", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
                            ["total_launched", "total_destroyed", "drones_launched", "drones_destroyed",
                             "missiles_launched", "missiles_destroyed"]], "attack_waves")


@query("A08_conditional_avg", """
SELECT l_linestatus,
  COALESCE(CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_discount AS DECIMAL(18,2)) END) AS DOUBLE)
    / COUNT(CASE WHEN l_returnflag = 'R' THEN l_discount END), 0) AS avg_disc_returned,
  COALESCE(CAST(SUM(CASE WHEN l_returnflag = 'X' THEN CAST(l_discount AS DECIMAL(18,2)) END) AS DOUBLE)
    / COUNT(CASE WHEN l_returnflag = 'X' THEN l_discount END), 0) AS avg_disc_none
FROM lineitem GROUP BY 1
""")
def a08(spark, sf):
    """AVG(CASE WHEN … THEN x END) without ELSE; a condition never met gives 0."""
    li = lineitem(spark, sf).withColumn("disc", dec("l_discount"))
    return aggs.conditional_avg(li, "l_linestatus", {"avg_disc_returned": (F.col("l_returnflag") == "R", "disc"),
                                                     "avg_disc_none": (F.col("l_returnflag") == "X", "disc")})


@query("A09_avg_or_zero", """
SELECT event_type, COALESCE(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value), 0) AS avg FROM events GROUP BY 1
""")
def a09(spark, sf):
    """Average event value per type, 0 when none."""
    return aggs.avg_or_zero(events(spark, sf), "event_type", "v")


@query("A10_count_distinct_group", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a10(spark, sf):
    """Distinct users per event type."""
    return aggs.count_distinct_group(table(spark, sf, "events"), "event_type", "user_id", "users")


@query("A11_having", f"""
SELECT src, dst, COUNT(*) AS n FROM ({SQL_PAIRS}) WHERE l_returnflag = 'R' AND src <> dst
GROUP BY 1, 2 HAVING COUNT(*) >= 20
""")
def a11(spark, sf):
    """Pair counts of returned lines, kept when ≥ 20 (post-aggregate filter)."""
    p = trade_pairs(spark, sf).filter(F.col("l_returnflag") == "R")
    return aggs.having(aggs.pair_stats(p, "src", "dst"), F.col("n") >= 20)


@query("A12_guarded_ratio", """
SELECT p_brand, CASE WHEN SUM(l_quantity) > 0 THEN
  round(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity) * 100, 1) ELSE 0 END AS return_rate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def a12(spark, sf):
    """Returned share of quantity per part brand, guarded against a zero total."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    g = li.groupBy("p_brand").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("ret"),
                                  F.sum("l_quantity").alias("tot"))
    return g.select("p_brand", aggs.guarded_ratio("ret", "tot", 1).alias("return_rate"))


@query("A12_guarded_ratio_daily", """
SELECT CAST(l_shipdate AS DATE) AS sd, CASE WHEN SUM(l_quantity) > 0
  THEN SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity) * 100 ELSE 0 END AS return_rate
FROM lineitem GROUP BY 1
""")
def a12_daily(spark, sf):
    """The daily, unrounded form of the guarded ratio (returned share of shipped quantity per day)."""
    g = lineitem(spark, sf).groupBy("sd").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("ret"), F.sum("l_quantity").alias("tot"))
    return g.select("sd", aggs.guarded_ratio("ret", "tot", None).alias("return_rate"))


@query("A13_pair_stats", f"""
SELECT src, dst, COUNT(*) AS n, CAST(SUM(disc) AS DOUBLE) / COUNT(disc) AS avg
FROM ({SQL_PAIRS}) WHERE src IS NOT NULL AND src <> '' AND dst IS NOT NULL AND dst <> '' AND src <> dst GROUP BY 1, 2
""")
def a13(spark, sf):
    """Per directed nation pair: line count and average discount (blank and self pairs excluded)."""
    return aggs.pair_stats(trade_pairs(spark, sf), "src", "dst", "disc")


SQL_PAIR_STATS_R = f"""SELECT src, dst, COUNT(*) AS n, CAST(SUM(disc) AS DOUBLE) / COUNT(disc) AS avg
FROM ({SQL_PAIRS}) WHERE l_returnflag = 'R' AND src <> dst GROUP BY 1, 2 HAVING COUNT(*) >= 20"""


def _pair_stats_r(spark, sf):
    p = trade_pairs(spark, sf).filter(F.col("l_returnflag") == "R")
    return aggs.having(aggs.pair_stats(p, "src", "dst", "disc"), F.col("n") >= 20)


@query("A14_pair_asymmetry", f"""
WITH ps AS ({SQL_PAIR_STATS_R})
SELECT a.src, a.dst, a.n AS n_ab, b.n AS n_ba, a.avg AS avg_ab, b.avg AS avg_ba,
  abs(a.avg - b.avg) AS avg_asymmetry, abs(a.n - b.n) AS volume_asymmetry
FROM ps a JOIN ps b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
""")
def a14(spark, sf):
    """Pair stats (≥ 20 returned lines) joined with the reverse direction, absolute differences."""
    j = joins.inverse_pair_join(_pair_stats_r(spark, sf), "src", "dst", ["n", "avg"])
    return aggs.pair_asymmetry(j, "avg_ab", "avg_ba", "n_ab", "n_ba")


@query("A15_bidirectional_counts", f"""
WITH p AS (
  SELECT CASE WHEN src = '{FOCAL}' THEN dst WHEN dst = '{FOCAL}' THEN src END AS country,
         CASE WHEN src = '{FOCAL}' THEN 'out' WHEN dst = '{FOCAL}' THEN 'in' END AS dir, disc
  FROM ({SQL_PAIRS}) WHERE (src = '{FOCAL}' OR dst = '{FOCAL}') AND src <> dst)
SELECT country, CAST(SUM(CASE WHEN dir = 'out' THEN 1 ELSE 0 END) AS BIGINT) AS out_count,
  CAST(SUM(CASE WHEN dir = 'in' THEN 1 ELSE 0 END) AS BIGINT) AS in_count,
  COALESCE(CAST(SUM(CASE WHEN dir = 'out' THEN disc END) AS DOUBLE) / COUNT(CASE WHEN dir = 'out' THEN disc END), 0) AS avg_out,
  COALESCE(CAST(SUM(CASE WHEN dir = 'in' THEN disc END) AS DOUBLE) / COUNT(CASE WHEN dir = 'in' THEN disc END), 0) AS avg_in
FROM p WHERE country IS NOT NULL AND country <> '' GROUP BY 1
ORDER BY out_count + in_count DESC, country LIMIT 25
""")
def a15(spark, sf):
    """Counterparties of the focal nation: out/in counts and averages, top 25 by total."""
    return aggs.bidirectional_counts(trade_pairs(spark, sf), "src", "dst", FOCAL, "disc", 25)


@query("A16_directional_weekly", f"""
WITH c AS (SELECT CAST(date_trunc('week', od) AS DATE) AS week,
  CASE WHEN src = '{FOCAL}' AND dst IS NOT NULL AND dst <> '{FOCAL}' THEN 'outbound'
       WHEN dst = '{FOCAL}' AND src IS NOT NULL AND src <> '{FOCAL}' THEN 'inbound'
       WHEN src = '{FOCAL}' AND dst = '{FOCAL}' THEN 'internal' ELSE 'other' END AS direction, disc, o_orderpriority
  FROM ({SQL_PAIRS}) WHERE od IS NOT NULL)
SELECT week, direction, COUNT(*) AS count, COALESCE(CAST(SUM(disc) AS DOUBLE) / COUNT(disc), 0) AS avg,
  CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS prefixed
FROM c GROUP BY 1, 2
""")
def a16(spark, sf):
    """Week × direction relative to the focal nation: count, average discount, urgent-order count."""
    return aggs.directional_weekly(trade_pairs(spark, sf), "od", "src", "dst", FOCAL, "disc", "o_orderpriority", "1")


@query("A17_rounded_histogram", """
SELECT CAST(round(CAST(value AS DECIMAL(38,6)), 0) AS DOUBLE) AS bin, COUNT(*) AS count FROM events
WHERE value IS NOT NULL GROUP BY 1
""")
def a17(spark, sf):
    """Histogram of event values rounded to whole numbers."""
    return aggs.rounded_histogram(table(spark, sf, "events"), "value", 0)


@query("A18_explode_count", """
SELECT item, COUNT(*) AS count FROM (
  SELECT unnest(CASE WHEN p_size > 45 THEN NULL ELSE string_split(p_name, ' ') END) AS item FROM part) GROUP BY 1
""")
def a18(spark, sf):
    """Words of part names (NULL arrays for large parts drop out)."""
    p = table(spark, sf, "part")
    arr = F.when(F.col("p_size") > 45, F.lit(None)).otherwise(F.split("p_name", " "))
    return aggs.explode_count(p.select(arr.alias("words")), "words")


@query("A18_explode_count_month", """
SELECT item, month, COUNT(*) AS count FROM (
  SELECT unnest(string_split(p_name, ' ')) AS item, CAST(date_trunc('month', l_shipdate) AS DATE) AS month
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2
""")
def a18_month(spark, sf):
    """Words of part names per ship month over all line items."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return aggs.explode_count(li.select(F.split("p_name", " ").alias("words"), "l_shipdate"), "words", "l_shipdate")


@query("A19_flags_to_counts", """
SELECT 'quality' AS label, COUNT(*) FILTER (WHERE quality = 1) AS count FROM labels
UNION ALL SELECT 'toxic', COUNT(*) FILTER (WHERE toxic = 1) FROM labels
UNION ALL SELECT 'both', COUNT(*) FILTER (WHERE quality + toxic = 2) FROM labels
UNION ALL SELECT 'flag_two', COUNT(*) FILTER (WHERE quality = 2) FROM labels
""")
def a19(spark, sf):
    """Wide 0/1 flags → (label, count), one scan; a never-set flag shows 0."""
    lb = table(spark, sf, "labels").withColumn("both", ((F.col("quality") + F.col("toxic")) == 2).cast("int")) \
        .withColumn("flag_two", (F.col("quality") == 2).cast("int"))
    return aggs.flags_to_counts(lb, {"quality": "quality", "toxic": "toxic", "both": "both", "flag_two": "flag_two"})


@query("A19_flags_to_counts_month", """
SELECT month, label, COUNT(*) AS count FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, 'returned' AS label FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS DATE), 'open' FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS DATE), 'discounted' FROM lineitem WHERE l_discount > 0.05
  UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS DATE), 'never' FROM lineitem WHERE l_quantity > 1000)
GROUP BY 1, 2
""")
def a19_month(spark, sf):
    """Monthly flag counts: only hits are counted, so a flag absent in a month has no row."""
    li = table(spark, sf, "lineitem").select(
        "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("f_ret"),
        (F.col("l_linestatus") == "O").cast("int").alias("f_open"), (F.col("l_discount") > 0.05).cast("int").alias("f_disc"),
        (F.col("l_quantity") > 1000).cast("int").alias("f_never"))
    return aggs.flags_to_counts(li, {"f_ret": "returned", "f_open": "open", "f_disc": "discounted", "f_never": "never"},
                                date="l_shipdate")


SQL_NATION_MONTH = """SELECT n.n_name AS nation, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
  COUNT(*) AS orders, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2"""


def _nation_month(spark, sf):
    o = orders(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    j = o.join(c, "o_custkey").join(n, "c_nationkey")
    return j.groupBy("nation", F.trunc("od", "month").alias("month")).agg(F.count(F.lit(1)).alias("orders"),
                                                                        F.sum("price").alias("revenue"))


@query("A20_superset_member", f"""
WITH nm AS ({SQL_NATION_MONTH})
SELECT nation, month, orders, CAST(revenue AS DOUBLE) AS revenue FROM nm
UNION ALL
SELECT 'Europe (All)', month, CAST(SUM(orders) AS BIGINT), CAST(SUM(revenue) AS DOUBLE) FROM nm
WHERE nation IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
GROUP BY month
""")
def a20(spark, sf):
    """Per nation × month, plus a synthetic 'Europe (All)' member summed over the region's nations."""
    nm = _nation_month(spark, sf)
    members = table(spark, sf, "nation").join(table(spark, sf, "region").filter(F.col("r_name") == "EUROPE")
                                              .select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select("n_name")
    r = aggs.superset_member(nm, "nation", members, "Europe (All)", ["month"], ["orders", "revenue"])
    return r.withColumn("revenue", F.col("revenue").cast("double"))


@query("A21_value_fallback_sum", f"""
SELECT c_mktsegment, CAST(SUM(CASE WHEN regexp_full_match(txt, '[0-9.]+') THEN COALESCE(TRY_CAST(txt AS DECIMAL(38,18)), 0)
  ELSE 0 END) AS DOUBLE) AS total, COUNT(*) AS count FROM ({SQL_DIRTY_BALANCE}) GROUP BY 1
""")
def a21(spark, sf):
    """Sum of dirty numeric text per segment (non-numbers count as 0)."""
    r = aggs.value_fallback_sum(_dirty_balance(spark, sf), "c_mktsegment", "txt")
    return r.withColumn("total", F.col("total").cast("double"))


SQL_SHIFT = "CAST('1000000000000000000000000000000' AS HUGEINT)"  # 10^30: the decimals of long_amounts


@query("A21_value_fallback_sum_long", f"""
SELECT o_orderpriority, CAST(w + f // {SQL_SHIFT} AS VARCHAR) ||
  CASE WHEN f % {SQL_SHIFT} = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(f % {SQL_SHIFT} AS VARCHAR), 30, '0'), '0') END AS total, count
FROM (SELECT o_orderpriority, SUM(CAST(w AS HUGEINT)) AS w, SUM(CAST(rpad(f, 30, '0') AS HUGEINT)) AS f, COUNT(*) AS count
  FROM ({SQL_LONG_SIDES}) GROUP BY 1)
""")
def a21_long(spark, sf):
    """Exact sums of amounts beyond 10^20 and of 30 decimals, per priority."""
    return aggs.value_fallback_sum(long_amounts(spark, sf), "o_orderpriority", "txt")


@query("A22_reaggregate_selected", """
WITH r AS (SELECT CAST(o_orderdate AS DATE) AS od, o_orderstatus, '  ' || o_orderpriority AS prio, COUNT(*) AS n,
  SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1, 2, 3)
SELECT CAST(date_trunc('month', od) AS DATE) AS month, o_orderstatus, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM r WHERE o_orderstatus IN ('F', 'O') AND trim(prio) IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2
""")
def a22(spark, sf):
    """A daily rollup re-filtered by two selected sets (keys trimmed) and re-summed by month."""
    o = orders(spark, sf).withColumn("prio", F.concat(F.lit("  "), "o_orderpriority"))
    r = o.groupBy("od", "o_orderstatus", "prio").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("revenue"))
    r = r.withColumn("month", F.trunc("od", "month"))
    out = aggs.reaggregate_selected(r, {"o_orderstatus": ["F", "O"], "prio": ["1-URGENT", "2-HIGH"]}, ["month", "o_orderstatus"],
                                    ["n", "revenue"], trim=["prio"])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("A23_reaggregate_coarser", f"""
SELECT CAST(date_trunc('month', od) AS DATE) AS month, CAST(SUM(n_orders) AS BIGINT) AS n_orders,
  CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM ({SQL_DAILY_ORDERS}) GROUP BY 1
""")
def a23(spark, sf):
    """Daily order rollup re-summed by month."""
    d = daily_orders(spark, sf).withColumn("revenue", dec("revenue"))
    r = aggs.reaggregate_coarser(d, [], ["n_orders", "revenue"], grain="month", date="od")
    return r.withColumn("revenue", F.col("revenue").cast("double"))


@query("A24_share_of_total", """
SELECT event_type, n, round(CAST(n AS DOUBLE) / (SELECT COUNT(*) FROM events) * 100, 1) AS pct
FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1)
""")
def a24(spark, sf):
    """Share of each event type in all events, in %."""
    r = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return aggs.share_of_total(r, "n", "pct", 1)


@query("A25_latest_row", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS od, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def a25(spark, sf):
    """Latest order per customer (ties on date broken by key) via max_by."""
    o = orders(spark, sf).select("o_custkey", "o_orderkey", "od", "o_totalprice")
    o = o.withColumn("__ord", F.struct("od", "o_orderkey"))
    return aggs.latest_row(o, "__ord", "o_custkey", ["o_orderkey", "od", "o_totalprice"])


SQL_MONTHLY_CHANGE = f"""SELECT month, last_total - lag(last_total) OVER (ORDER BY month) AS change FROM (
  SELECT strftime(sd, '%Y-%m') AS month, arg_max(total, sd) AS last_total FROM ({SQL_RUNNING_QTY}) GROUP BY 1)"""


@query("A26_peak_abs", f"""
SELECT month, change FROM ({SQL_MONTHLY_CHANGE}) WHERE change IS NOT NULL ORDER BY abs(change) DESC, month LIMIT 1
""")
def a26(spark, sf):
    """Month with the largest absolute change (earliest on ties)."""
    mc = series.monthly_change(running_qty(spark, sf), None, "sd", "total")
    return aggs.peak_abs(mc, "change", "month")


SQL_DAILY_DIFF = f"""SELECT sd, qty - lag(qty) OVER (ORDER BY sd) AS qty_diff FROM ({SQL_DAILY_QTY})"""


@query("A27_period_summary", f"""
SELECT SUM(qty_diff) AS total_change, MAX(qty_diff) AS max_gain, MIN(qty_diff) AS max_loss,
  COUNT(*) FILTER (WHERE qty_diff > 0) AS positive_periods, COUNT(*) FILTER (WHERE qty_diff < 0) AS negative_periods,
  SUM(qty_diff) / COUNT(qty_diff) AS mean_change
FROM ({SQL_DAILY_DIFF}) WHERE qty_diff IS NOT NULL
""")
def a27(spark, sf):
    """Summary of day-over-day quantity changes: total, max gain/loss, counts up/down, mean."""
    d = series.diff_lag1(daily_qty(spark, sf), None, "sd", ["qty"])
    return aggs.period_summary(d, "qty_diff")


@query("A28_range_summary", f"""
SELECT COALESCE(arg_max(qty, sd), 0) AS current, COALESCE(arg_max(qty, sd) - arg_min(qty, sd), 0) AS net_change,
  COALESCE((arg_max(qty, sd) - arg_min(qty, sd)) / COUNT(*) * 30, 0) AS monthly_avg
FROM ({SQL_DAILY_QTY}) WHERE sd BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
""")
def a28(spark, sf):
    """1996 daily quantity: last value, net change, monthly average of the change."""
    return aggs.range_summary(daily_qty(spark, sf), "sd", "qty", "1996-01-01", "1996-12-31")


def _pearson_sql(x: str, y: str) -> str:
    return (f"COALESCE(((COUNT(*) * SUM({x} * {y})) - (SUM({x}) * SUM({y}))) / NULLIF(sqrt(((COUNT(*) * SUM({x} * {x})) - "
            f"(SUM({x}) * SUM({x}))) * ((COUNT(*) * SUM({y} * {y})) - (SUM({y}) * SUM({y})))), 0), 0)")


SQL_DAILY_CLICKS_VS_PURCHASES = """SELECT d, CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS clicks,
  CAST(COUNT(*) FILTER (WHERE event_type = 'purchase' AND value > 40) AS DOUBLE) AS big FROM (
  SELECT CAST(ts AS DATE) AS d, event_type, value FROM events) GROUP BY 1"""


@query("A29_pearson", f"SELECT {_pearson_sql('clicks', 'big')} AS r FROM ({SQL_DAILY_CLICKS_VS_PURCHASES})")
def a29(spark, sf):
    """Sum-form Pearson r of two daily series (J01 output)."""
    from chronoframe.plans.q_joins import j01
    d = j01(spark, sf)
    return aggs.pearson(d, "clicks", "big_purchases")


@query("A29_pearson_by_year", f"""
SELECT year, {_pearson_sql('n_orders', 'n_lines')} AS r FROM (
  SELECT CAST(year(od) AS INTEGER) AS year, CAST(n_orders AS DOUBLE) AS n_orders, CAST(COALESCE(n_lines, 0) AS DOUBLE) AS n_lines
  FROM ({SQL_DAILY_ORDERS}) o LEFT JOIN ({SQL_DAILY_QTY}) q ON o.od = q.sd) GROUP BY 1
""")
def a29_by_year(spark, sf):
    """Per-year Pearson r of daily order count vs daily shipped line count."""
    o = daily_orders(spark, sf).join(daily_qty(spark, sf).withColumnRenamed("sd", "od"), "od", "left") \
        .withColumn("year", F.year("od")).fillna(0, subset=["n_lines"])
    return aggs.pearson(o, "n_orders", "n_lines", keys="year")


def _merged_daily_types(spark, sf):
    """Four daily series of one (day, type) rollup side by side: events are scanned once."""
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return joins.date_merge_rollup(daily, "d", "event_type", "n", EVENT_TYPES)


SQL_MERGED_TYPES = ("SELECT CAST(ts AS DATE) AS d, " + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE event_type = '{t}') AS DOUBLE) AS {t}" for t in EVENT_TYPES)
    + " FROM events WHERE event_type IN (" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + ") GROUP BY 1")


def _corr_matrix_sql() -> str:
    parts = []
    for a in EVENT_TYPES:
        for b in EVENT_TYPES:
            if a == b:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CAST(1.0 AS DOUBLE) AS r")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {_pearson_sql(a, b)} AS r FROM m")
    return f"WITH m AS ({SQL_MERGED_TYPES}) " + " UNION ALL ".join(parts)


@query("A30_correlation_matrix", _corr_matrix_sql())
def a30(spark, sf):
    """All pairwise r over four merged daily series in one aggregate, stacked long."""
    m = _merged_daily_types(spark, sf).select("d", *[F.col(t).cast("double").alias(t) for t in EVENT_TYPES])
    return aggs.correlation_matrix(m, EVENT_TYPES)


SQL_SUPPLY_SERIES = """SELECT n.n_name || l.l_returnflag AS s, CAST(l.l_shipdate AS DATE) AS d, SUM(l.l_quantity) AS v
FROM lineitem l JOIN supplier p ON l.l_suppkey = p.s_suppkey JOIN nation n ON p.s_nationkey = n.n_nationkey GROUP BY 1, 2"""


@query("A30_correlation_matrix_long", f"""
WITH x AS MATERIALIZED ({SQL_SUPPLY_SERIES}), n AS (SELECT count(DISTINCT d) AS n FROM x),
m AS (SELECT s, sum(v) AS sx, sum(v * v) AS sxx FROM x GROUP BY s),
g AS (SELECT a.s AS a, b.s AS b, sum(a.v * b.v) AS xy FROM x a JOIN x b ON a.d = b.d GROUP BY 1, 2)
SELECT p.s AS a, q.s AS b, CASE WHEN p.s = q.s THEN 1.0 WHEN (n * p.sxx - p.sx * p.sx) * (n * q.sxx - q.sx * q.sx) > 0
  THEN (n * coalesce(xy, 0) - p.sx * q.sx) / sqrt((n * p.sxx - p.sx * p.sx) * (n * q.sxx - q.sx * q.sx)) ELSE 0.0 END AS r
FROM m p CROSS JOIN m q CROSS JOIN n LEFT JOIN g ON g.a = p.s AND g.b = q.s
""")
def a30_long(spark, sf):
    """Every pair of daily series, one series a supplier nation and return flag, as a blocked Gram matrix."""
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey") \
        .join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    x = lineitem(spark, sf).join(s, "l_suppkey").groupBy(F.concat("n_name", "l_returnflag").alias("s"), F.col("sd").alias("d")) \
        .agg(F.sum("l_quantity").alias("v"))
    return aggs.correlation_matrix_long(x, "s", "d", "v")


@query("A31_linear_trend", f"""
WITH s AS (SELECT od, CAST(n_orders AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY od) - 1 AS DOUBLE) AS x
           FROM ({SQL_DAILY_ORDERS})),
f AS (SELECT ((COUNT(*) * SUM(x * y)) - (SUM(x) * SUM(y))) / ((COUNT(*) * SUM(x * x)) - (SUM(x) * SUM(x))) AS slope,
             SUM(x) AS sx, SUM(y) AS sy, CAST(COUNT(*) AS DOUBLE) AS n FROM s)
SELECT s.od, CAST(s.y AS BIGINT) AS n_orders, f.slope, (f.sy - f.slope * f.sx) / f.n AS intercept,
  (f.sy - f.slope * f.sx) / f.n + f.slope * s.x AS trend
FROM s, f
""")
def a31(spark, sf):
    """Least-squares line over the row index of the daily order count."""
    d = daily_orders(spark, sf).select("od", "n_orders")
    return aggs.linear_trend(d, "od", "n_orders")


SQL_LP = """SELECT CAST(l_shipdate AS DATE) AS sd, l_quantity AS launched,
  CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS destroyed,
  CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS model
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _lp(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return li.select(F.to_date("l_shipdate").alias("sd"), F.col("l_quantity").alias("launched"),
                     F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("destroyed"),
                     F.when(F.col("p_size") > 45, F.lit(None)).otherwise(F.col("p_name")).alias("model"))


@query("A32_split_daily", f"""
SELECT sd, SUM(launched) AS total_launched, SUM(destroyed) AS total_destroyed, COUNT(model) AS attacks,
  SUM(CASE WHEN COALESCE(regexp_matches(model, 'red|gizmo', 'i'), false) THEN launched ELSE 0 END) AS drones_launched,
  SUM(CASE WHEN COALESCE(regexp_matches(model, 'red|gizmo', 'i'), false) THEN destroyed ELSE 0 END) AS drones_destroyed,
  SUM(launched) - SUM(CASE WHEN COALESCE(regexp_matches(model, 'red|gizmo', 'i'), false) THEN launched ELSE 0 END) AS missiles_launched,
  SUM(destroyed) - SUM(CASE WHEN COALESCE(regexp_matches(model, 'red|gizmo', 'i'), false) THEN destroyed ELSE 0 END) AS missiles_destroyed
FROM ({SQL_LP}) WHERE sd IS NOT NULL GROUP BY 1
""")
def a32(spark, sf):
    """Daily totals split into a name-pattern part and the rest, one pass."""
    return aggs.split_daily(_lp(spark, sf), "sd", "model", "red|gizmo", "launched", "destroyed", "model")


@query("A33_by_category_rate", f"""
SELECT model, COALESCE(SUM(launched), 0) AS total_launched, COALESCE(SUM(destroyed), 0) AS total_destroyed,
  COUNT(sd) AS attacks, CASE WHEN COALESCE(SUM(launched), 0) > 0
    THEN round(COALESCE(SUM(destroyed), 0) / COALESCE(SUM(launched), 0) * 100, 1) ELSE 0 END AS intercept_rate
FROM ({SQL_LP}) GROUP BY 1
""")
def a33(spark, sf):
    """Per model: sums, record count, guarded intercept rate (the NULL model is its own group)."""
    return aggs.by_category_rate(_lp(spark, sf), "model", "destroyed", "launched", "sd")
