"""Driver queries for sources.

Each query renders a landed file set from a driver table (see ``fixtures``)
and reads it back through the source operator; the oracle is the table
itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import sources
from chronoframe.plans import fixtures as fz
from chronoframe.plans.common import query, table
from chronoframe.session import scratch_path

ORDERS_DDL = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, "
              "o_orderpriority string")
SQL_ORDERS_TYPED = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, "
                    "o_orderpriority FROM orders")


def _orders_dated(spark, sf):
    return table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("S01_scan_table", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0
""")
def s01(spark, sf):
    """Parquet scan with projection and a parameter-bound predicate (pushed to the scan)."""
    return sources.scan_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                              "o_orderstatus = :s AND o_totalprice > :p", {"s": "F", "p": 100000.0})


@query("S02_scan_csv", SQL_ORDERS_TYPED)
def s02(spark, sf):
    """Header CSV written by Spark, read back typed by a declared schema."""
    path = scratch_path(spark, "orders-csv")
    _orders_dated(spark, sf).write.option("header", True).csv(path)
    return sources.scan_csv(spark, path, ORDERS_DDL)


@query("S03_scan_csv_preamble", SQL_ORDERS_TYPED)
def s03(spark, sf):
    """Each file starts with free-text lines; the header is the first line starting with the marker."""
    path = fz.write_csv_files(_orders_dated(spark, sf), "orders-preamble",
                              lambda header: ["Daily order report", "generated by the export job, do not edit", "", header])
    return sources.scan_csv_preamble(spark, path, "o_orderkey,", ORDERS_DDL)


@query("S04_scan_csv_tagrow", SQL_ORDERS_TYPED)
def s04(spark, sf):
    """Each file's second line is a '#' tag row; only that line is dropped."""
    o = _orders_dated(spark, sf)
    tags = ",".join("#" + c.split("_", 1)[-1] for c in o.columns)
    path = fz.write_csv_files(o, "orders-tagrow", lambda header: [header, tags])
    return sources.scan_csv_tagrow(spark, path, ORDERS_DDL)


NOTES_DDL = "o_orderkey bigint, note string, o_totalprice double"
SQL_NOTES = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority || chr(10) || 'said "' || o_orderstatus || '", twice' || chr(10)
  WHEN 'O' THEN 'a "quoted" word, ' || o_orderpriority ELSE o_orderpriority END AS note, o_totalprice FROM orders"""


def _notes(spark, sf):
    """Orders with a free-text note: line breaks, quotes and commas inside a field."""
    p, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    note = (F.when(status == "F", F.concat(p, F.lit('\nsaid "'), status, F.lit('", twice\n')))
            .when(status == "O", F.concat(F.lit('a "quoted" word, '), p)).otherwise(p))
    return table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")


@query("S02_scan_csv_quoted", SQL_NOTES)
def s02_quoted(spark, sf):
    """Header CSV with line breaks, doubled quotes and commas inside quoted fields."""
    path = fz.write_csv_files(_notes(spark, sf), "notes-csv", lambda header: [header])
    return sources.scan_csv(spark, path, NOTES_DDL)


@query("S03_scan_csv_preamble_quoted", SQL_NOTES)
def s03_quoted(spark, sf):
    """Whole records behind a preamble that itself holds a stray quote."""
    path = fz.write_csv_files(_notes(spark, sf), "notes-preamble",
                              lambda header: ['Notes, 5" paper', "generated by the export job", "", header])
    return sources.scan_csv_preamble(spark, path, "o_orderkey,", NOTES_DDL)


@query("S04_scan_csv_tagrow_quoted", SQL_NOTES)
def s04_quoted(spark, sf):
    """Whole records behind a header and a '#' tag row."""
    path = fz.write_csv_files(_notes(spark, sf), "notes-tagrow", lambda header: [header, "#key,#note,#price"])
    return sources.scan_csv_tagrow(spark, path, NOTES_DDL)


@query("S05_scan_csv_in_zip", SQL_ORDERS_TYPED)
def s05(spark, sf):
    """ZIP archives with a BOM-prefixed CSV member picked by name; other members ignored."""
    path = fz.write_zipped_csv(_orders_dated(spark, sf), "orders-zip", "daily_data_orders.csv")
    return sources.scan_csv_in_zip(spark, path, r"^daily_data.*\.csv$", ORDERS_DDL)


PAGE_ROWS = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
CUSTOMER_ODD_KEYS = {"customer key": "c_custkey", "account balance*": "c_acctbal", "market segment": "c_mktsegment"}


@query("S06_scan_json_array", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def s06(spark, sf):
    """Files holding one JSON array of records with odd keys, renamed on read."""
    c = table(spark, sf, "customer").select(*[F.col(v).alias(k) for k, v in CUSTOMER_ODD_KEYS.items()])
    path = fz.write_json_pages(c, "customer-json-array", lambda rows, n: F.to_json(rows))
    odd_schema = ", ".join(f"`{k}` {t}" for k, t in zip(CUSTOMER_ODD_KEYS, ["bigint", "double", "string"]))
    return sources.scan_json_array(spark, path, CUSTOMER_ODD_KEYS, schema=odd_schema)


@query("S07_scan_json_pages", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s07(spark, sf):
    """API pages {"data": [...], "maxPages": n} → rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = fz.write_json_pages(o, "orders-pages",
                               lambda rows, n: F.to_json(F.struct(rows.alias("data"), F.lit(n).alias("maxPages"))))
    return sources.scan_json_pages(spark, path, "data", PAGE_ROWS)


@query("S07_scan_json_pages_items", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s07_items(spark, sf):
    """API pages {"items": [...], "maxPages": n} → rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = fz.write_json_pages(o, "orders-pages-items",
                               lambda rows, n: F.to_json(F.struct(rows.alias("items"), F.lit(n).alias("maxPages"))))
    return sources.scan_json_pages(spark, path, "items", PAGE_ROWS)


@query("S07_scan_json_pages_meta", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s07_meta(spark, sf):
    """API pages shaped [meta, [rows]] → rows (row schema declared)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    def page(rows, n):
        meta = F.to_json(F.struct(F.lit(1).alias("page"), F.lit(n).alias("pages"), F.size(rows).alias("per_page")))
        return F.concat(F.lit("["), meta, F.lit(","), F.to_json(rows), F.lit("]"))
    path = fz.write_json_pages(o, "orders-pages-meta", page)
    return sources.scan_json_pages(spark, path, None, PAGE_ROWS)


@query("S07_scan_json_variant", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_totalprice END AS price,
  CASE o_orderstatus WHEN 'O' THEN o_orderpriority END AS note FROM orders
""")
def s07_variant(spark, sf):
    """Pages that disagree: the price is a number, a numeric text or absent, an odd key holds a text or an object."""
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    record = F.when(status == "F", F.to_json(F.struct("o_orderkey", F.struct("o_orderpriority").alias("note*")))).when(
        status == "O", F.to_json(F.struct("o_orderkey", F.col("o_totalprice").alias("price (eur)"), F.col("o_orderpriority").alias("note*")))
    ).otherwise(F.to_json(F.struct("o_orderkey", F.col("o_totalprice").cast("string").alias("price (eur)"))))
    path = fz.write_json_pages(o.select(record.alias("j")), "orders-pages-odd",
                               lambda rows, n: F.concat(F.lit('{"data": ['), F.array_join(F.transform(rows, lambda r: r["j"]), ","),
                                                        F.lit("]}")))
    return sources.scan_json_variant(spark, path, "$.data", {
        "o_orderkey": ("$.o_orderkey", "bigint"), "price": ("$['price (eur)']", "double"), "note": ("$['note*']", "string")
    }).withColumn("note", F.when(~F.col("note").startswith("{"), F.col("note")))


SQL_GEO_BOXES = """WITH b AS (SELECT CAST(ts AS DATE) AS date, event_type, min(value) AS x0, max(value) AS x1,
    CAST(min(user_id) AS DOUBLE) AS y0, CAST(max(user_id) AS DOUBLE) AS y1 FROM events GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY event_type) - 1 AS feature_id FROM b)"""


@query("S08_scan_geojson", SQL_GEO_BOXES + """
SELECT date, CAST(feature_id AS INTEGER) AS feature_id, 0 AS ring, v.vertex, v.lon, v.lat FROM f,
  LATERAL (SELECT * FROM (VALUES (0, x0, y0), (1, x1, y0), (2, x1, y1), (3, x0, y1), (4, x0, y0)) t(vertex, lon, lat)) v
""")
def s08(spark, sf):
    """One GeoJSON FeatureCollection per day (the date in the path); each event type's
    value × user bounding box is a polygon; read back as one row per vertex."""
    e = table(spark, sf, "events").withColumn("date", F.to_date("ts").cast("string"))
    boxes = e.groupBy("date", "event_type").agg(F.min("value").alias("x0"), F.max("value").alias("x1"),
                                                 F.min("user_id").cast("double").alias("y0"),
                                                 F.max("user_id").cast("double").alias("y1"))

    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in
                     [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]])
    feature = F.struct(F.col("event_type").alias("__k"),
                       F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    # one FeatureCollection per day (a handful of features), ordered by type
    per_day = boxes.groupBy("date").agg(F.sort_array(F.collect_list(feature)).alias("__f"))
    features = F.transform("__f", lambda f: F.struct(F.lit("Feature").alias("type"),
                                                      F.create_map(F.lit("event_type"), f["__k"]).alias("properties"),
                                                      f["geometry"].alias("geometry")))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features")))
    path = scratch_path(spark, "events-geojson")
    per_day.select("date", doc.alias("value")).write.partitionBy("date").text(path)
    return sources.scan_geojson(spark, path)


@query("S09_rename_map", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def s09(spark, sf):
    """External header → canonical names, declared order, a missing source column ignored."""
    c = table(spark, sf, "customer")
    return sources.rename_map(c, {"c_custkey": "id", "c_name": "name", "c_phone": "phone", "c_mktsegment": "segment"})
