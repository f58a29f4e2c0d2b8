"""Driver queries for sinks, incremental loads and orchestration.

Targets and batches are carved from the driver tables by date or category
(never by id ranges), committed as snapshots in the shared scratch folder,
loaded, and the new snapshot is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import functions as fx
from chronoframe.operators import aggs, loads
from chronoframe.plans.common import (
    SQL_DAILY_QTY_FLAG, daily_qty, dec, orders, query, table,
)
from chronoframe.session import scratch_path

ASOF = "2002-01-01"


def _snap(df, name):
    """Commit ``df`` as a snapshot in a fresh scratch directory and read it back."""
    spark = df.sparkSession
    path = loads.write_snapshot(df, scratch_path(spark, name))
    return spark.read.parquet(path)


SQL_A05 = """SELECT NULLIF(o_orderstatus, 'P') AS status, o_orderpriority, COUNT(*) AS count,
  CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total,
  strftime(MIN(o_orderdate), '%Y-%m-%d') AS first_date, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_date
FROM orders GROUP BY 1, 2"""


@query("K01_sink_json", SQL_A05)
def k01(spark, sf):
    """A rollup written as JSON (ISO dates, decimals as doubles) and read back."""
    o = orders(spark, sf).withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    r = aggs.group_count_sum(o, ["status", "o_orderpriority"], "price", "od")
    path = loads.sink_json(r, scratch_path(spark, "a05-json"))
    schema = "status string, o_orderpriority string, count long, total double, first_date string, last_date string"
    return spark.read.schema(schema).json(path)


# Fixed values of the driver query: named, uneven, inclusive YYYYMMDD periods.
PERIODS = {"1996_q1": (19960101, 19960331), "1996_q2": (19960401, 19960630), "1996_q3": (19960701, 19960930),
           "1996_q4": (19961001, 19961231), "1997_h1": (19970101, 19970630), "1997_h2": (19970701, 19971231),
           "1998": (19980101, 19981231), "1999_2000": (19990101, 20001231), "2030": (20300101, 20301231)}


@query("K02_sink_period_partitions", "SELECT period, COUNT(*) AS n, MIN(od) AS first_day, MAX(od) AS last_day FROM ("
       "SELECT CAST(o_orderdate AS DATE) AS od, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d FROM orders) o "
       "JOIN (VALUES " + ", ".join(f"('{k}', {lo}, {hi})" for k, (lo, hi) in PERIODS.items())
       + ") p(period, lo, hi) ON o.d BETWEEN p.lo AND p.hi GROUP BY 1")
def k02(spark, sf):
    """Orders written as one partition per named period (rows outside all periods dropped;
    an empty period writes nothing), then summarised from the written files."""
    o = orders(spark, sf).select("o_orderkey", "od", fx.date_to_int("od").alias("d"))
    path = loads.sink_period_partitions(o, "d", PERIODS, scratch_path(spark, "orders-periods"))
    back = spark.read.schema(loads.assign_periods(o, "d", PERIODS).schema).parquet(path)  # declared: empty input writes no files
    return back.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("od").alias("first_day"), F.max("od").alias("last_day"))


@query("K03_nested_document", """
SELECT o.count AS orders_count, o.min_date AS orders_min_date, o.max_date AS orders_max_date,
  l.count AS lineitem_count, l.qty AS lineitem_qty, e.count AS events_count, e.users AS events_users
FROM (SELECT COUNT(*) AS count, MIN(CAST(o_orderdate AS DATE)) AS min_date, MAX(CAST(o_orderdate AS DATE)) AS max_date FROM orders) o,
  (SELECT COUNT(*) AS count, SUM(l_quantity) AS qty FROM lineitem) l,
  (SELECT COUNT(*) AS count, COUNT(DISTINCT user_id) AS users FROM events) e
""")
def k03(spark, sf):
    """Overview document: one aggregate per table assembled into one nested row (flattened here)."""
    doc = loads.nested_document({
        "orders": (orders(spark, sf), {"count": F.count(F.lit(1)), "min_date": F.min("od"), "max_date": F.max("od")}),
        "lineitem": (table(spark, sf, "lineitem"), {"count": F.count(F.lit(1)), "qty": F.sum("l_quantity")}),
        "events": (table(spark, sf, "events"), {"count": F.count(F.lit(1)), "users": F.count_distinct("user_id")}),
    })
    return doc.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s, cs in
                        [("orders", ["count", "min_date", "max_date"]), ("lineitem", ["count", "qty"]), ("events", ["count", "users"])]
                        for c in cs])


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("od"))


@query("K04_append_ignore", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END
  AS o_totalprice, CAST(o_orderdate AS DATE) AS od FROM orders
""")
def k04(spark, sf):
    """ON CONFLICT DO NOTHING: target = orders before 1998; batch = orders from 1997 on,
    each key twice (first copy has price + 1). Keys in the target are skipped, the
    first copy of each new key wins."""
    o = _order_rows(spark, sf)
    target = _snap(o.filter(F.col("od") < "1998-01-01"), "k04-target")
    later = o.filter(F.col("od") >= "1997-01-01")
    batch = later.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("ord", F.lit(0)) \
        .unionByName(later.withColumn("ord", F.lit(1)))
    return _snap(loads.append_ignore(target, batch, "o_orderkey", "ord"), "k04-result")


@query("K04_append_ignore_incremental", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END
  AS o_totalprice, CAST(o_orderdate AS DATE) AS od FROM orders
""")
def k04_incremental(spark, sf):
    """K04 committed as an append of only the new rows to a year-partitioned table."""
    o = _order_rows(spark, sf).withColumn("year", F.year("od"))
    path = scratch_path(spark, "k04i-table")
    o.filter(F.col("od") < "1998-01-01").write.partitionBy("year").parquet(path)
    target = spark.read.schema(o.schema).parquet(path)
    later = o.filter(F.col("od") >= "1997-01-01")
    batch = later.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("ord", F.lit(0)) \
        .unionByName(later.withColumn("ord", F.lit(1)))
    loads.commit_append(loads.append_ignore_delta(target, batch, "o_orderkey", "ord"), path, ["year"])
    return spark.read.schema(o.schema).parquet(path).drop("year")


@query("K05_truncate_load", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS od FROM orders "
       "WHERE o_orderstatus = 'O'")
def k05(spark, sf):
    """Full replace of the target by a non-empty batch."""
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("od")]
    target = _snap(o.filter(F.col("o_orderstatus") == "F").select(*cols), "k05-target")
    batch = o.filter(F.col("o_orderstatus") == "O").select(*cols)
    return _snap(loads.truncate_load(target, batch), "k05-result")


@query("K05_truncate_load_empty", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS od FROM orders "
       "WHERE o_orderstatus = 'F'")
def k05_empty(spark, sf):
    """An empty batch leaves the target untouched."""
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("od")]
    target = _snap(o.filter(F.col("o_orderstatus") == "F").select(*cols), "k05e-target")
    batch = o.filter(F.col("o_orderstatus") == "none").select(*cols)
    return _snap(loads.truncate_load(target, batch), "k05e-result")


@query("K06_delete_range_load", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS od FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice + 1, CAST(o_orderdate AS DATE) FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
""")
def k06(spark, sf):
    """Delete date ≥ min(batch date), insert the batch: 1999 is replaced and the newer years vanish."""
    o = _order_rows(spark, sf)
    target = _snap(o, "k06-target")
    batch = o.filter((F.col("od") >= "1999-01-01") & (F.col("od") < "2000-01-01")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return _snap(loads.delete_range_load(target, batch, "od"), "k06-result")


@query("K07_upsert", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 20 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
""")
def k07(spark, sf):
    """Insert-or-update by key; within the batch the later change (+20 after +10) wins; new keys insert."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    target = _snap(c.drop("c_mktsegment"), "k07-target")
    m = c.filter(F.col("c_mktsegment") == "MACHINERY")
    batch = (m.withColumn("c_acctbal", F.col("c_acctbal") + 10).withColumn("seq", F.lit(1))
             .unionByName(m.withColumn("c_acctbal", F.col("c_acctbal") + 20).withColumn("seq", F.lit(2)))
             .unionByName(c.filter(F.col("c_mktsegment") == "HOUSEHOLD")
                          .withColumn("c_custkey", F.col("c_custkey") + 1000000000).withColumn("seq", F.lit(1)))).drop("c_mktsegment")
    return _snap(loads.upsert(target, batch, "c_custkey", "seq"), "k07-result")


@query("K07_upsert_partitions", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 20 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
""")
def k07_partitions(spark, sf):
    """K07 committed by rewriting only the segment partitions the batch touches."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "k07p-table")
    c.write.partitionBy("c_mktsegment").parquet(path)
    m = c.filter(F.col("c_mktsegment") == "MACHINERY")
    batch = (m.withColumn("c_acctbal", F.col("c_acctbal") + 10).withColumn("seq", F.lit(1))
             .unionByName(m.withColumn("c_acctbal", F.col("c_acctbal") + 20).withColumn("seq", F.lit(2)))
             .unionByName(c.filter(F.col("c_mktsegment") == "HOUSEHOLD")
                          .withColumn("c_custkey", F.col("c_custkey") + 1000000000).withColumn("seq", F.lit(1))))
    loads.upsert_partitions(path, batch, "c_custkey", "seq", ["c_mktsegment"], scratch_path(spark, "k07p-staging"),
                            schema=c.schema)
    return spark.read.schema(c.schema).parquet(path).select("c_custkey", "c_name", "c_acctbal")


@query("K08_update_from", """
SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 5 THEN CASE WHEN s_nationkey = 0 THEN NULL ELSE s_acctbal * 2 END
  ELSE s_acctbal END AS s_acctbal FROM supplier
""")
def k08(spark, sf):
    """UPDATE … FROM a keyed side table: matched rows take the side value, even NULL."""
    s = table(spark, sf, "supplier")
    target = _snap(s.select("s_suppkey", "s_name", "s_acctbal"), "k08-target")
    side = s.filter(F.col("s_nationkey") < 5).select(
        "s_suppkey", F.when(F.col("s_nationkey") == 0, F.lit(None).cast("double")).otherwise(F.col("s_acctbal") * 2).alias("s_acctbal"))
    return _snap(loads.update_from(target, side, "s_suppkey", "s_acctbal"), "k08-result")


@query("K08_update_from_last", """
SELECT s_suppkey, s_name, CASE WHEN l.l_suppkey IS NULL THEN s_acctbal ELSE l.price END AS s_acctbal
FROM supplier s LEFT JOIN (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1) l ON s.s_suppkey = l.l_suppkey
""")
def k08_last(spark, sf):
    """Many side rows a key: the supplier's last line sets the value, NULL included."""
    target = _snap(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "k08-last-target")
    side = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.struct("l_orderkey", "l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("s_acctbal"))
    return _snap(loads.update_from(target, side, "s_suppkey", "s_acctbal", order="line"), "k08-last-result")


@query("K09_high_water_mark", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-06-01' AND CAST(o_orderdate AS DATE) > (
  SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
""")
def k09(spark, sf):
    """Only batch rows after the target's high-water mark are new."""
    o = orders(spark, sf).select("o_orderkey", "od")
    target = _snap(o.filter(F.col("od") < "2000-01-01"), "k09-target")
    batch = o.filter(F.col("od") >= "1999-06-01")
    return loads.high_water_mark(target, batch, "od", default="2022-02-24")


@query("K09_high_water_mark_default", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-06-30'
""")
def k09_default(spark, sf):
    """An empty target falls back to the default floor date."""
    o = orders(spark, sf).select("o_orderkey", "od")
    target = o.filter(F.col("od") < "1900-01-01")
    return loads.high_water_mark(target, o, "od", default="2000-06-30")


SQL_YEAR_COUNTS = "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1"


def _year_counts(spark, sf):
    return orders(spark, sf).groupBy(F.year("od").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("K09_incremental_update", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS od, o_orderpriority FROM orders
""")
def k09_update(spark, sf):
    """The incremental update chain: a landed all-text CSV is typed by declared casters, cut at the
    target's high-water mark and appended (only new rows) to the year-partitioned table."""
    from chronoframe import sources
    from chronoframe.operators import clean
    from chronoframe.plans import fixtures as fz
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("od"),
                                          "o_orderpriority")
    path = scratch_path(spark, "k09u-table")
    typed_schema = o.withColumn("year", F.year("od"))
    typed_schema.filter(F.col("od") < "2000-01-01").write.partitionBy("year").parquet(path)
    landed = fz.write_csv_files(o.filter(F.col("od") >= "1999-07-01"), "k09u-landing", lambda header: [header])
    text = sources.scan_csv(spark, landed, ", ".join(f"`{c}` string" for c in o.columns))
    batch = clean.typed_projection(text, {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "float", "od": "date",
                                          "o_orderpriority": "text"})
    target = spark.read.schema(typed_schema.schema).parquet(path)
    fresh = loads.high_water_mark(target, batch, "od", default="1990-01-01").withColumn("year", F.year("od"))
    loads.commit_append(fresh.select(*target.columns), path, ["year"])
    return spark.read.schema(typed_schema.schema).parquet(path).drop("year")


@query("K10_refresh_if_newer", SQL_YEAR_COUNTS)
def k10(spark, sf):
    """The batch holds a newer year than the target → full replace."""
    y = _year_counts(spark, sf)
    target = _snap(y.filter(F.col("year") < 2000), "k10-target")
    return loads.refresh_if_newer(target, y, "year")


@query("K10_refresh_if_newer_stale", f"SELECT * FROM ({SQL_YEAR_COUNTS}) WHERE year < 2000")
def k10_stale(spark, sf):
    """The batch holds no newer year → the target stays."""
    y = _year_counts(spark, sf)
    target = _snap(y.filter(F.col("year") < 2000), "k10s-target")
    return loads.refresh_if_newer(target, y.filter(F.col("year") < 1998), "year")


@query("K11_chunk_range", """
SELECT CAST(s AS DATE) AS chunk_start, least(CAST(s AS DATE) + 89, hi) AS chunk_end FROM (
  SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 90 DAY)) AS s, hi FROM (
    SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders))
""")
def k11(spark, sf):
    """The orders date span cut into 90-day closed chunks."""
    b = orders(spark, sf).agg(F.min("od").alias("start"), F.max("od").alias("end"))
    return loads.chunk_range(b, "start", "end", 90)


def _stats(spark, sf):
    return loads.dataset_stats({"orders": (table(spark, sf, "orders"), "o_orderdate"),
                                "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"),
                                "events": (table(spark, sf, "events"), "ts"),
                                "customer": (table(spark, sf, "customer"), None),
                                "supplier": (table(spark, sf, "supplier"), None)})


def _baseline(spark, sf):
    o = table(spark, sf, "orders")
    return loads.dataset_stats({"orders": (o.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")), "o_orderdate"),
                                "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"),
                                "customer": (table(spark, sf, "customer"), None),
                                "supplier": (table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0), None)})


SQL_CHANGES = """WITH s AS (
  SELECT 'orders' AS key, MAX(CAST(o_orderdate AS DATE)) AS max_date, COUNT(*) AS count FROM orders
  UNION ALL SELECT 'lineitem', MAX(CAST(l_shipdate AS DATE)), COUNT(*) FROM lineitem
  UNION ALL SELECT 'events', MAX(CAST(ts AS DATE)), COUNT(*) FROM events
  UNION ALL SELECT 'customer', NULL, COUNT(*) FROM customer
  UNION ALL SELECT 'supplier', NULL, COUNT(*) FROM supplier),
b AS (
  SELECT 'orders' AS key, MAX(CAST(o_orderdate AS DATE)) AS max_date, COUNT(*) AS count FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'
  UNION ALL SELECT 'lineitem', MAX(CAST(l_shipdate AS DATE)), COUNT(*) FROM lineitem
  UNION ALL SELECT 'customer', NULL, COUNT(*) FROM customer
  UNION ALL SELECT 'supplier', NULL, COUNT(*) FROM supplier WHERE s_acctbal > 0),
c AS (SELECT s.key, CASE WHEN b.count IS NULL THEN 'new' WHEN s.count IS DISTINCT FROM b.count THEN 'count'
    WHEN s.max_date IS DISTINCT FROM b.max_date THEN 'max_date' ELSE 'unchanged' END AS reason
  FROM s LEFT JOIN b ON s.key = b.key)
"""


@query("K12_detect_changes", SQL_CHANGES + "SELECT key, reason <> 'unchanged' AS changed, reason FROM c")
def k12(spark, sf):
    """(max date, count) per dataset vs a stored baseline: changed if either differs; no baseline → new."""
    return loads.detect_changes(_stats(spark, sf), _baseline(spark, sf))


# Which outputs each dataset feeds (configuration, not data).
OUTPUTS = [("orders", "daily_orders"), ("orders", "orders_by_region"), ("lineitem", "shipments"),
           ("events", "daily_events"), ("events", "events_by_type"), ("customer", "customers"), ("supplier", "suppliers")]


@query("K13_affected_outputs", SQL_CHANGES + "SELECT DISTINCT output FROM (SELECT output FROM (VALUES " + ", ".join(
    f"('{k}', '{o}')" for k, o in OUTPUTS) + ") m(key, output) WHERE key IN (SELECT key FROM c WHERE reason <> 'unchanged') "
       "UNION ALL SELECT 'overview')")
def k13(spark, sf):
    """Outputs to re-export: those fed by changed datasets, plus the overview."""
    changes = loads.detect_changes(_stats(spark, sf), _baseline(spark, sf))
    mapping = spark.createDataFrame(OUTPUTS, "key string, output string")
    return loads.affected_outputs(changes, mapping, ["overview"])


def _outputs(spark, sf) -> dict:
    """The rollups the export writes, keyed by the output names of OUTPUTS."""
    o, e = orders(spark, sf), table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    by_region = o.join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return {
        "daily_orders": o.groupBy("od").agg(F.count(F.lit(1)).alias("orders"), F.sum("price").alias("revenue")),
        "orders_by_region": by_region.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders")),
        "shipments": table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("sd")).agg(F.count(F.lit(1)).alias("lines")),
        "daily_events": e.groupBy("d").agg(F.count(F.lit(1)).alias("events")),
        "events_by_type": e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")),
        "customers": table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers")),
        "suppliers": table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")),
        "overview": loads.nested_document({"orders": (o, {"count": F.count(F.lit(1))}),
                                           "events": (e, {"count": F.count(F.lit(1))})}),
    }


@query("K13_selective_export", SQL_CHANGES + """, affected AS (
  SELECT DISTINCT output FROM (SELECT output FROM (VALUES """ + ", ".join(f"('{k}', '{o}')" for k, o in OUTPUTS)
       + """) m(key, output) WHERE key IN (SELECT key FROM c WHERE reason <> 'unchanged') UNION ALL SELECT 'overview')),
sizes AS (
  SELECT 'daily_orders' AS output, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS rows FROM orders
  UNION ALL SELECT 'orders_by_region', COUNT(DISTINCT r.r_name) FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
    JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT 'shipments', COUNT(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem
  UNION ALL SELECT 'daily_events', COUNT(DISTINCT CAST(ts AS DATE)) FROM events
  UNION ALL SELECT 'events_by_type', COUNT(DISTINCT event_type) FROM events
  UNION ALL SELECT 'customers', COUNT(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'suppliers', COUNT(DISTINCT s_nationkey) FROM supplier
  UNION ALL SELECT 'overview', 1)
SELECT a.output, s.rows FROM affected a JOIN sizes s ON a.output = s.output
""")
def k13_export(spark, sf):
    """Selective re-export: change detection → affected outputs → only those rollups written as JSON,
    with a manifest of rows counted back from the files."""
    changes = loads.detect_changes(_stats(spark, sf), _baseline(spark, sf))
    mapping = spark.createDataFrame(OUTPUTS, "key string, output string")
    affected = [r[0] for r in loads.affected_outputs(changes, mapping, ["overview"]).collect()]  # a few output names
    manifest = loads.export_outputs(_outputs(spark, sf), scratch_path(spark, "export"), only=affected)
    return manifest.select("output", "rows")


@query("K13_second_run", SQL_CHANGES + """, affected AS (
  SELECT DISTINCT output FROM (VALUES """ + ", ".join(f"('{k}', '{o}')" for k, o in OUTPUTS)
       + """) m(key, output) WHERE key IN (SELECT key FROM c WHERE reason <> 'unchanged'))
SELECT 1 AS run, COUNT(*) AS outputs FROM affected UNION ALL SELECT 2, CAST(0 AS BIGINT)
""")
def k13_second_run(spark, sf):
    """Two export runs against the stored baseline: the first writes what changed and stores the new
    baseline, the second finds no change and writes nothing."""
    mapping = spark.createDataFrame(OUTPUTS, "key string, output string")
    paths = [loads.write_snapshot(_baseline(spark, sf), scratch_path(spark, "baseline"))]
    runs = None
    for run in (1, 2):
        paths.append(scratch_path(spark, "baseline"))
        manifest = loads.export_changed(_stats(spark, sf), paths[-2], mapping, _outputs(spark, sf),
                                        scratch_path(spark, "export"), paths[-1])
        row = manifest.agg(F.count(F.lit(1)).alias("outputs")).select(F.lit(run).alias("run"), "outputs")
        runs = row if runs is None else runs.unionByName(row)
    return runs


@query("K14_refresh_rollup", f"""
SELECT l_returnflag, sd, qty, qty - lag(qty) OVER w AS change,
  CASE WHEN lag(qty) OVER w <> 0 THEN (qty - lag(qty) OVER w) / lag(qty) OVER w * 100.0 END AS change_pct
FROM ({SQL_DAILY_QTY_FLAG}) WINDOW w AS (PARTITION BY l_returnflag ORDER BY sd)
""")
def k14(spark, sf):
    """Recompute the daily rollup with change / change_pct and commit it as a new snapshot."""
    d = daily_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", "qty")
    return _snap(loads.refresh_rollup(d, "l_returnflag", "sd", "qty"), "k14-rollup")


@query("K15_staleness_report", f"""
SELECT 'events' AS table_name, COUNT(*) AS rows, MAX(CAST(ts AS DATE)) AS max_date,
  CAST(date_diff('day', MAX(CAST(ts AS DATE)), DATE '{ASOF}') AS INTEGER) AS days_stale FROM events
UNION ALL SELECT 'orders_int', COUNT(*), MAX(CAST(o_orderdate AS DATE)), CAST(date_diff('day', MAX(CAST(o_orderdate AS DATE)), DATE '{ASOF}') AS INTEGER) FROM orders
UNION ALL SELECT 'lineitem_ts14', COUNT(*), MAX(CAST(l_shipdate AS DATE)), CAST(date_diff('day', MAX(CAST(l_shipdate AS DATE)), DATE '{ASOF}') AS INTEGER) FROM lineitem
UNION ALL SELECT 'orders_year', COUNT(*), make_date(MAX(year(o_orderdate)), 1, 1), CAST(date_diff('day', make_date(MAX(year(o_orderdate)), 1, 1), DATE '{ASOF}') AS INTEGER) FROM orders
UNION ALL SELECT 'customer_text', COUNT(*), NULL, CAST(NULL AS INTEGER) FROM customer
UNION ALL SELECT 'orders_text', COUNT(*), MAX(CAST(o_orderdate AS DATE)), CAST(date_diff('day', MAX(CAST(o_orderdate AS DATE)), DATE '{ASOF}') AS INTEGER) FROM orders
""")
def k15(spark, sf):
    """Rows, decoded max date and days stale for date columns of every kind."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    frames = {
        "events": (table(spark, sf, "events"), "ts"),
        "orders_int": (o.select(fx.date_to_int("o_orderdate").alias("d")), "d"),
        "lineitem_ts14": (li.select((fx.date_to_int("l_shipdate").cast("long") * 1000000 + 120000).alias("d")), "d"),
        "orders_year": (o.select(F.year("o_orderdate").alias("d")), "d"),
        "customer_text": (table(spark, sf, "customer").select(F.col("c_name").alias("d")), "d"),
        "orders_text": (o.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("d")), "d"),
    }
    return loads.staleness_report(frames, ASOF)


# The source each driver table is reported under.
SOURCES = {"region": "reference", "nation": "reference", "customer": "crm", "supplier": "crm", "part": "catalog",
           "orders": "sales", "lineitem": "sales", "events": "telemetry", "labels": "corpus", "documents": "corpus"}


def _fmt_sql(c: str) -> str:
    return (f"CASE WHEN {c} >= 1000000 THEN printf('%.1fM', round({c} / 1e6, 1)) WHEN {c} >= 1000 THEN "
            f"printf('%.1fK', round({c} / 1e3, 1)) ELSE CAST({c} AS VARCHAR) END")


@query("K16_inventory", "WITH t AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t, s in SOURCES.items())
    + "), a AS (SELECT * FROM t UNION ALL SELECT source, '*', SUM(row_count) FROM t GROUP BY source) "
    + f"SELECT source, table_name, CAST(row_count AS BIGINT) AS row_count, {_fmt_sql('row_count')} AS formatted FROM a")
def k16(spark, sf):
    """Table inventory: rows per table, human-formatted, and a total row per source."""
    return loads.inventory({t: table(spark, sf, t) for t in SOURCES}, SOURCES)


@query("K17_region_rollup_load", """
SELECT r.r_name AS region, CAST(l.l_shipdate AS DATE) AS date, SUM(l.l_quantity) AS tonnes,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS eur,
  CAST(SUM(COALESCE(CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE CAST(l.l_tax AS DECIMAL(18,2)) END, 0)) AS DOUBLE) AS usd,
  arg_min(l.l_linestatus, (l.l_orderkey, l.l_linenumber, l.l_linestatus)) AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
""")
def k17(spark, sf):
    """API grain (one row per line) rolled to (region, day): sums with missing → 0,
    date from the first 10 characters of a text timestamp, first-seen metadata."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey") \
        .join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey") \
        .join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    api = li.select(F.col("r_name").alias("region"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_text"),
                    F.col("l_quantity").alias("tonnes"), dec("l_extendedprice").alias("eur"),
                    F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(dec("l_tax")).alias("usd"),
                    F.col("l_linestatus").alias("status"),
                    (F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)")
                     + F.col("l_linenumber").cast("decimal(10,0)")).alias("seen"))  # (order, line) as one number; ties by status
    r = loads.region_rollup_load(api, "region", "ts_text", ["tonnes", "eur", "usd"], ["status"], order="seen")
    return r.withColumn("eur", F.col("eur").cast("double")).withColumn("usd", F.col("usd").cast("double"))
