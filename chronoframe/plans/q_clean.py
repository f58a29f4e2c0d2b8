"""Driver queries for projections, predicates and cleaning.

The driver tables hold no NULLs or dirty text, so the edge cases the
reference handles (blank categories, NaN, malformed dates, dirty numbers)
are manufactured from real columns inside each query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import functions as fx
from chronoframe.operators import clean
from chronoframe.plans.common import SQL_PAIRS, dec, orders, query, table, trade_pairs

FOCAL = "NATION_3"


@query("P01_project_alias", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS amount FROM orders
""")
def p01(spark, sf):
    """Orders projected and renamed (id, order_date, amount)."""
    return clean.project_alias(table(spark, sf, "orders"),
                               {"id": "o_orderkey", "order_date": F.to_date("o_orderdate"), "amount": "o_totalprice"})


@query("P02_case_label", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders
""")
def p02(spark, sf):
    """Order status code → label with an ELSE branch (literal map, no join)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return clean.case_label(o, "o_orderstatus", {"F": "fulfilled", "O": "open"}, "other").drop("o_orderstatus")


@query("P03_dict_label", """
SELECT c_custkey, c_nationkey, COALESCE(n.n_name, 'Code ' || CAST(c_nationkey AS VARCHAR)) AS label
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) n ON c_nationkey = n.n_nationkey
""")
def p03(spark, sf):
    """Customer nation labels from a dictionary with one code missing → 'Code 7'."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    d = table(spark, sf, "nation").filter(F.col("n_nationkey") != 7)
    return clean.dict_label(c, "c_nationkey", d, "n_nationkey", "n_name")


@query("P04_direction_class", f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN src = '{FOCAL}' AND dst IS NOT NULL AND dst <> '{FOCAL}' THEN 'outbound'
       WHEN dst = '{FOCAL}' AND src IS NOT NULL AND src <> '{FOCAL}' THEN 'inbound'
       WHEN src = '{FOCAL}' AND dst = '{FOCAL}' THEN 'internal' ELSE 'other' END AS direction
FROM ({SQL_PAIRS})
""")
def p04(spark, sf):
    """Direction of each customer-nation → supplier-nation line relative to a focal nation."""
    p = trade_pairs(spark, sf)
    return clean.direction_class(p, "src", "dst", FOCAL).select("l_orderkey", "l_linenumber", "direction")


@query("P05_counterparty", f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN src = '{FOCAL}' THEN dst WHEN dst = '{FOCAL}' THEN src END AS country,
  CASE WHEN src = '{FOCAL}' THEN 'out' WHEN dst = '{FOCAL}' THEN 'in' END AS direction
FROM ({SQL_PAIRS})
WHERE (src = '{FOCAL}' OR dst = '{FOCAL}') AND src <> dst AND src IS NOT NULL AND dst IS NOT NULL
""")
def p05(spark, sf):
    """For lines touching the focal nation: the other nation and the direction."""
    p = trade_pairs(spark, sf)
    return clean.counterparty(p, "src", "dst", FOCAL).select("l_orderkey", "l_linenumber", "country", "direction")


def _dirty_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderstatus") == "O", F.lit(""))
        .otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Not available")).otherwise(F.col("o_orderpriority")).alias("priority"))


SQL_DIRTY_ORDERS = """SELECT o_orderkey,
  CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Not available' ELSE o_orderpriority END AS priority FROM orders"""


@query("P06_filter_not_blank", f"""
SELECT * FROM ({SQL_DIRTY_ORDERS}) WHERE status IS NOT NULL AND status <> '' AND status <> 'Not available'
  AND priority IS NOT NULL AND priority <> '' AND priority <> 'Not available'
""")
def p06(spark, sf):
    """Orders whose status and priority are neither NULL, blank nor the 'Not available' sentinel."""
    return clean.filter_not_blank(_dirty_orders(spark, sf), ["status", "priority"], ["Not available"])


@query("P07_filter_equals", "SELECT event_id, CAST(ts AS DATE) AS d, value FROM events WHERE event_type = 'error'")
def p07(spark, sf):
    """Events of one type (a pushed-down equality filter)."""
    e = table(spark, sf, "events")
    return clean.filter_equals(e, "event_type", "error").select("event_id", F.to_date("ts").alias("d"), "value")


@query("P08_filter_int_range", """
SELECT * FROM (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS od_int FROM orders)
WHERE od_int BETWEEN 19960101 AND 19961231
""")
def p08(spark, sf):
    """Orders whose YYYYMMDD integer date lies in 1996 (closed range)."""
    o = table(spark, sf, "orders").select("o_orderkey", fx.date_to_int("o_orderdate").alias("od_int"))
    return clean.filter_int_range(o, "od_int", 19960101, 19961231)


@query("P09_filter_in_set", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def p09(spark, sf):
    """Events whose type is in a selected set."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    return clean.filter_in_set(e, "event_type", ["error", "signup"])


@query("P09_filter_in_set_empty", "SELECT event_id, event_type FROM events WHERE false")
def p09_empty(spark, sf):
    """An empty selection selects nothing (the whole table is still planned)."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    return clean.filter_in_set(e, "event_type", [])


@query("P10_filter_date_range", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'
""")
def p10(spark, sf):
    """Orders inside a closed ISO date window."""
    o = orders(spark, sf).select("o_orderkey", "od")
    return clean.filter_date_range(o, "od", "1996-03-01", "1996-06-30")


@query("P10_filter_date_range_lenient", """
SELECT o_orderkey, txt FROM (
  SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txt
  FROM orders)
WHERE TRY_CAST(txt AS DATE) IS NULL OR TRY_CAST(txt AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'
""")
def p10_lenient(spark, sf):
    """Text dates; values that are not dates are kept (the lenient variant)."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("txt"))
    return clean.filter_date_range(o, "txt", "1996-03-01", "1996-06-30", keep_unparseable=True)


@query("P11_filter_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PRO%'")
def p11(spark, sf):
    """Parts whose type starts with a prefix."""
    return clean.filter_prefix(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "PRO")


@query("P12_filter_icontains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'RED|Gizmo|bolt', 'i')")
def p12(spark, sf):
    """Parts whose name contains one of several words, case-insensitively."""
    return clean.filter_icontains(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "RED|Gizmo|bolt")


SQL_DIRTY_BALANCE = """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '1.2.3' WHEN 'BUILDING' THEN ''
  WHEN 'AUTOMOBILE' THEN '1e6' ELSE printf('%.2f', c_acctbal) END AS txt, c_mktsegment FROM customer"""


def _dirty_balance(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    txt = (F.when(seg == "HOUSEHOLD", "1.2.3").when(seg == "BUILDING", "").when(seg == "AUTOMOBILE", "1e6")
           .otherwise(F.format_string("%.2f", "c_acctbal")))
    return c.select("c_custkey", txt.alias("txt"), "c_mktsegment")


@query("P13_guarded_numeric", f"""
SELECT c_custkey, CAST(CASE WHEN regexp_full_match(txt, '[0-9.]+') THEN COALESCE(TRY_CAST(txt AS DECIMAL(38,18)), 0)
  ELSE 0 END AS DOUBLE) AS amount FROM ({SQL_DIRTY_BALANCE})
""")
def p13(spark, sf):
    """Dirty numeric text → value if it looks numeric and casts, else 0."""
    d = clean.guarded_numeric(_dirty_balance(spark, sf), "txt", "amount")
    return d.select("c_custkey", F.col("amount").cast("double").alias("amount"))


SQL_LONG_AMOUNT = """SELECT o_orderkey, o_orderpriority, CASE o_orderstatus
  WHEN 'F' THEN '98765432109876543210' || printf('%.2f', o_totalprice)
  WHEN 'O' THEN printf('%.2f', o_totalprice) || '0000000000000000000000000012' ELSE '1.2.3' END AS txt FROM orders"""
SQL_LONG_SIDES = f"""SELECT *, split_part(n, '.', 1) AS w, split_part(n, '.', 2) AS f FROM (
  SELECT *, CASE WHEN regexp_full_match(txt, '[0-9]*[.]?[0-9]*') THEN txt ELSE '0' END AS n FROM ({SQL_LONG_AMOUNT}))"""


def long_amounts(spark, sf):
    """Amounts beyond 10^20 (status F), of 30 decimals (O), and text that is no number (P)."""
    price = F.format_string("%.2f", "o_totalprice")
    txt = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("98765432109876543210"), price))
           .when(F.col("o_orderstatus") == "O", F.concat(price, F.lit("0000000000000000000000000012"))).otherwise("1.2.3"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", txt.alias("txt"))


@query("P13_guarded_numeric_long", f"""
SELECT o_orderkey, CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END
  || CASE WHEN rtrim(f, '0') = '' THEN '' ELSE '.' || rtrim(f, '0') END AS amount, CAST(n AS DOUBLE) AS nearest
FROM ({SQL_LONG_SIDES})
""")
def p13_long(spark, sf):
    """Amounts longer than any DECIMAL: every digit, and the nearest double."""
    d = clean.guarded_numeric(long_amounts(spark, sf), "txt", "amount")
    return d.select("o_orderkey", "amount", F.col("amount").cast("double").alias("nearest"))


SQL_DOTTED_TXT = """SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN strftime(o_orderdate, '%d.%m.%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%dT10:00')
  WHEN '3-MEDIUM' THEN 'Not available' WHEN '4-NOT SPECIFIED' THEN '99.99.' || strftime(o_orderdate, '%Y')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txt FROM orders"""


@query("P14_parse_mixed_date", f"""
SELECT o_orderkey, txt, CASE WHEN regexp_matches(txt, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}')
    THEN CAST(TRY_STRPTIME(txt, '%d.%m.%Y') AS DATE)
  WHEN regexp_matches(txt, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr(txt, 1, 10) AS DATE) END AS parsed_date
FROM ({SQL_DOTTED_TXT})
""")
def p14(spark, sf):
    """DD.MM.YYYY / ISO-prefix routed parse; sentinel and impossible dates → NULL."""
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    txt = (F.when(p == "1-URGENT", F.date_format("o_orderdate", "dd.MM.yyyy"))
           .when(p == "2-HIGH", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00")))
           .when(p == "3-MEDIUM", F.lit("Not available"))
           .when(p == "4-NOT SPECIFIED", F.concat(F.lit("99.99."), F.date_format("o_orderdate", "yyyy")))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return clean.parse_mixed_date(o.select("o_orderkey", txt.alias("txt")), "txt", "dotted")


@query("P14_parse_mixed_date_dayname", """
SELECT o_orderkey, txt, CAST(COALESCE(TRY_STRPTIME(txt, '%d %B %Y'), TRY_STRPTIME(txt, '%Y-%m-%d')) AS DATE) AS parsed_date
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%-d %B %Y')
        WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS txt FROM orders)
""")
def p14_dayname(spark, sf):
    """'25 January 2026' or ISO, else NULL (strptime fallbacks)."""
    o = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    txt = (F.when(s == "F", F.date_format("o_orderdate", "d MMMM yyyy"))
           .when(s == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("n/a")))
    return clean.parse_mixed_date(o.select("o_orderkey", txt.alias("txt")), "txt", "dayname")


@query("P15_int_date", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS od_int, CAST(o_orderdate AS DATE) AS od,
  CAST(o_orderdate AS DATE) AS ts14_date FROM orders
""")
def p15(spark, sf):
    """date → YYYYMMDD → date, and YYYYMMDDHHMMSS bigint → date (integer division)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = clean.int_date(o, "o_orderdate", "to_int", "od_int")
    o = clean.int_date(o, "od_int", "to_date", "od")
    o = o.withColumn("ts14", F.col("od_int").cast("long") * 1000000 + F.lit(153012))
    return clean.int_date(o, "ts14", "ts14", "ts14_date").select("o_orderkey", "od_int", "od", "ts14_date")


SQL_TEXT_ORDERS = """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.0' AS key_txt,
  CASE o_orderstatus WHEN 'P' THEN 'nan' WHEN 'O' THEN '#N/A' ELSE printf('%.2f', o_totalprice) END AS price_txt,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_txt, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' AS date_txt,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '-' ELSE CAST(o_custkey AS VARCHAR) END AS cust_txt,
  o_orderstatus
FROM orders"""


def _text_orders(spark, sf):
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("key_txt"),
        F.when(st == "P", "nan").when(st == "O", "#N/A").otherwise(F.format_string("%.2f", "o_totalprice")).alias("price_txt"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_txt"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("date_txt"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "-").otherwise(F.col("o_custkey").cast("string")).alias("cust_txt"),
        "o_orderstatus")


@query("P16_safe_cast", f"""
SELECT o_orderkey, CAST(TRY_CAST(key_txt AS DOUBLE) AS BIGINT) AS key_txt,
  CASE WHEN o_orderstatus = 'F' THEN TRY_CAST(price_txt AS DOUBLE) END AS price_txt,
  strftime(CAST(replace(ts_txt, 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_txt,
  CAST(substr(date_txt, 1, 10) AS DATE) AS date_txt,
  CASE WHEN cust_txt = '-' THEN 0 ELSE CAST(cust_txt AS BIGINT) END AS cust_txt
FROM ({SQL_TEXT_ORDERS})
""")
def p16(spark, sf):
    """Per-column safe casts: float-text int, nan/#N/A float, Z timestamp, date prefix, '-' → 0."""
    t = clean.safe_cast(_text_orders(spark, sf), {"key_txt": "int", "price_txt": "float", "ts_txt": "timestamp",
                                                   "date_txt": "date", "cust_txt": "int_dash0"})
    return t.withColumn("ts_txt", F.date_format("ts_txt", "yyyy-MM-dd HH:mm:ss")).drop("o_orderstatus")


@query("P16_safe_cast_strict", f"""
SELECT o_orderkey, CASE WHEN regexp_full_match(trim(key_txt), '[+-]?[0-9]+') THEN TRY_CAST(trim(key_txt) AS BIGINT) END AS key_txt,
  CASE WHEN regexp_full_match(trim(cust_txt), '[+-]?[0-9]+') THEN TRY_CAST(trim(cust_txt) AS BIGINT) END AS cust_txt
FROM ({SQL_TEXT_ORDERS})
""")
def p16_strict(spark, sf):
    """The strict integer caster: '703448.0' and '-' are rejected (NULL), plain integers parse."""
    t = clean.safe_cast(_text_orders(spark, sf), {"key_txt": "int_strict", "cust_txt": "int_strict"})
    return t.select("o_orderkey", "key_txt", "cust_txt")


@query("P17_typed_projection", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def p17(spark, sf):
    """All-text customer rows → typed columns in declared order (blank → NULL)."""
    c = table(spark, sf, "customer")
    txt = c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
                   F.col("c_nationkey").cast("string").alias("c_nationkey"),
                   F.format_string("%.2f", "c_acctbal").alias("c_acctbal"),
                   F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    spec = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"}
    return clean.typed_projection(txt, spec)


@query("P18_null_fill", """
SELECT o_orderkey, COALESCE(CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN NULL ELSE o_totalprice END, 0.0) AS price,
  COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'unknown') AS priority FROM orders
""")
def p18(spark, sf):
    """NaN → NULL, then COALESCE defaults (NULL price → 0, NULL priority → 'unknown')."""
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    d = o.select("o_orderkey",
                 F.when(st == "P", F.lit(None).cast("double")).when(st == "O", F.lit(float("nan")))
                 .otherwise(F.col("o_totalprice")).alias("price"),
                 F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    return clean.null_fill(d, {"price": 0.0, "priority": "unknown"}, nan_as_null=["price"])


@query("P19_total_fallback", """
SELECT l_orderkey, l_linenumber, COALESCE(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN NULL ELSE l_quantity END + l_linenumber, 0) AS total
FROM lineitem
""")
def p19(spark, sf):
    """COALESCE(total, a + b, 0) on the raw parts: a NULL part makes the fallback 0."""
    li = table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_quantity")).alias("total"),
                  F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), F.lit(None))
                  .otherwise(F.col("l_quantity")).alias("part_a"),
                  F.col("l_linenumber").alias("part_b"))
    return clean.total_fallback(d, "total", ["part_a", "part_b"]).select("l_orderkey", "l_linenumber", "total")


@query("P20_tier_bucket", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 150000 THEN 'mid' ELSE 'low' END AS tier,
  CASE WHEN abs(o_totalprice - 250000) >= 200000 THEN 'far' WHEN abs(o_totalprice - 250000) >= 100000 THEN 'near'
       ELSE 'close' END AS band FROM orders
""")
def p20(spark, sf):
    """Order price tiers by descending bounds, and bands on an absolute deviation."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") - 250000).alias("dev"))
    o = clean.tier_bucket(o, "o_totalprice", [300000, 150000], ["high", "mid", "low"], "tier")
    o = clean.tier_bucket(o, "dev", [200000, 100000], ["far", "near", "close"], "band", absolute=True)
    return o.select("o_orderkey", "tier", "band")


@query("P21_clip", "SELECT c_custkey, greatest(-500, least(500, c_acctbal)) AS clipped FROM customer")
def p21(spark, sf):
    """Customer balances clamped to ±500."""
    return clean.clip(table(spark, sf, "customer"), "c_acctbal", -500, 500, "clipped").select("c_custkey", "clipped")


@query("P22_scale_units", "SELECT o_orderkey, o_totalprice / 1000.0 AS price_k, o_totalprice * 100 AS price_cents FROM orders")
def p22(spark, sf):
    """Order prices rescaled (thousands, cents)."""
    o = clean.scale_units(table(spark, sf, "orders"), "o_totalprice", 1000.0, "price_k", divide=True)
    return clean.scale_units(o, "o_totalprice", 100.0, "price_cents").select("o_orderkey", "price_k", "price_cents")


@query("P23_date_part_key", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
  CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS ym
FROM orders WHERE year(o_orderdate) >= 1996
""")
def p23(spark, sf):
    """Month key by format and zero-padded Y-MM from year/month ints (years < 1996 dropped)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"),
                                          F.month("o_orderdate").alias("m"))
    o = clean.date_part_key(o, "o_orderdate", "yyyy-MM", "month")
    return clean.year_month_key(o, "y", "m", "ym", min_year=1996).select("o_orderkey", "month", "ym")


@query("P24_truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS snippet FROM documents
""")
def p24(spark, sf):
    """Document text cut to 150 characters + '...' when longer (whole texts are measured)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return clean.truncate_text(d, "text", 150, out="snippet").select("doc_id", "snippet")


@query("P24_truncate_text_short", """
SELECT doc_id, CASE WHEN length(source || ': ' || lang || ' document') > 18
  THEN substr(source || ': ' || lang || ' document', 1, 16) || '...' ELSE source || ': ' || lang || ' document' END AS label
FROM documents
""")
def p24_short(spark, sf):
    """Short labels: longer than 18 characters → first 16 + '...'."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(": "), "lang", F.lit(" document")).alias("label"))
    return clean.truncate_text(d, "label", 18, 16)


@query("P25_trim_key", "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY 1")
def p25(spark, sf):
    """Keys padded with blanks group together once trimmed."""
    c = table(spark, sf, "customer")
    padded = c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), "c_mktsegment"))
                      .otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("segment"))
    return clean.trim_key(padded, "segment").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("P26_name_crosswalk", """
SELECT c.c_custkey, COALESCE(m.dst, n.n_name) AS country
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT n_name AS src, 'N' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation WHERE n_nationkey < 10) m
  ON n.n_name = m.src
WHERE COALESCE(m.dst, n.n_name) NOT IN ('NATION_24', 'N0')
""")
def p26(spark, sf):
    """Names mapped through a crosswalk table (identity when unmapped), excluded names dropped."""
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    xw = n.filter(F.col("n_nationkey") < 10).select(F.col("n_name").alias("src"),
                                                      F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"))
    return clean.name_crosswalk(c.select("c_custkey", "n_name"), "n_name", xw, "src", "dst", ["NATION_24", "N0"],
                                out="country").select("c_custkey", "country")


SQL_NATION_YEAR_B = """SELECT CASE WHEN n.n_nationkey < 10 THEN 'N' || CAST(n.n_nationkey AS VARCHAR) ELSE n.n_name END AS country,
  CAST(year(o.o_orderdate) AS INTEGER) AS year, COUNT(*) AS orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2"""


@query("P26_name_crosswalk_select", f"""
WITH xw AS (SELECT n_name AS a, 'N' || CAST(n_nationkey AS VARCHAR) AS b FROM nation WHERE n_nationkey < 10),
sel AS (SELECT DISTINCT n.n_name AS a FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE c.c_acctbal > 9900 AND n.n_name NOT IN ('NATION_24', 'NATION_5')),
wanted AS (SELECT COALESCE(xw.b, sel.a) AS b FROM sel LEFT JOIN xw ON sel.a = xw.a UNION SELECT 'N5' UNION SELECT 'NATION_24')
SELECT COALESCE(xw.a, t.country) AS country, t.year, t.orders
FROM ({SQL_NATION_YEAR_B}) t LEFT JOIN xw ON t.country = xw.b
WHERE t.country IN (SELECT b FROM wanted)
""")
def p26_select(spark, sf):
    """Nations picked in one vocabulary (rich customers' nations, two excluded), mapped to another,
    reference members always added, the yearly order table filtered and reported back in the first."""
    n = table(spark, sf, "nation")
    xw = n.filter(F.col("n_nationkey") < 10).select(F.col("n_name").alias("a"),
                                                    F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("b"))
    names = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(names, "c_nationkey")
    selection = c.filter(F.col("c_acctbal") > 9900).select("n_name").distinct()
    nb = n.select(F.col("n_nationkey").alias("c_nationkey"),
                  F.when(F.col("n_nationkey") < 10, F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
                  .otherwise(F.col("n_name")).alias("country"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(nb, "c_nationkey")
    t = o.groupBy("country", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return clean.name_crosswalk_select(t, "country", selection, xw, "a", "b", exclude=["NATION_24", "NATION_5"],
                                       include=["N5", "NATION_24"])


@query("P27_falsy_null", """
SELECT c_custkey, NULLIF(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE c_acctbal END, 0) AS share,
  COALESCE(CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END, 0) AS amount FROM customer
""")
def p27(spark, sf):
    """Zero/NULL → NULL for a ratio column, NULL → 0 for an amount column."""
    c = table(spark, sf, "customer")
    d = c.select("c_custkey",
                 F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("share"),
                 F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None)).otherwise(F.col("c_acctbal")).alias("amount"))
    return clean.falsy_null(clean.falsy_null(d, "share", "null"), "amount", "zero")


@query("P28_round_decimals", """
SELECT l_orderkey, l_linenumber,
  CAST(round(CAST(l_extendedprice - 50000 AS DECIMAL(18,2)), 1) AS DOUBLE) AS r_half_up,
  CAST(round_even(CAST(l_extendedprice - 50000 AS DECIMAL(18,2)), 1) AS DOUBLE) AS r_half_even,
  CAST(floor(CAST(l_extendedprice - 50000 AS DECIMAL(18,2)) * 10 + 0.5) / 10 AS DOUBLE) AS r_js
FROM lineitem
""")
def p28(spark, sf):
    """Three rounding conventions on exact decimals (ties are common at 1 digit)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dec(F.col("l_extendedprice") - 50000).alias("x"))
    for mode in ("half_up", "half_even", "js"):
        li = clean.round_decimals(li, "x", 1, mode, f"r_{mode}")
    return li.select("l_orderkey", "l_linenumber", *[F.col(f"r_{m}").cast("double").alias(f"r_{m}")
                                                     for m in ("half_up", "half_even", "js")])


@query("P29_literal_tag", "SELECT o_orderkey, 'orders' AS source FROM orders")
def p29(spark, sf):
    """A constant column tagging the branch."""
    return clean.literal_tag(table(spark, sf, "orders").select("o_orderkey"), "source", "orders")
