"""Driver queries for the streaming forms.

Each query lands files derived from a driver table in the shared scratch
folder, runs the stream over them with ``trigger(availableNow=True)`` into a
file sink with its own checkpoint, and returns the sink read back as a batch
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import streaming as st
from chronoframe.plans.common import SQL_DAILY_QTY_FLAG, daily_qty, query, table
from chronoframe.session import scratch_path

THRESHOLD = 5.0


def _land(df, path, mode="append"):
    df.write.mode(mode).parquet(path)


def _chunks(values: list, n: int) -> list[list]:
    """Split an ordered (small, calendar-bounded) list into n consecutive runs."""
    size = max(1, -(-len(values) // n))
    return [values[i:i + size] for i in range(0, len(values), size)]


@query("X01_stream_ingest_dedup", "SELECT event_id, event_type, value, CAST(ts AS DATE) AS d FROM events")
def x01(spark, sf):
    """Events landed twice; the stream drops repeated keys within the watermark."""
    e = table(spark, sf, "events")
    src = scratch_path(spark, "x01-landing")
    _land(e, src)
    _land(e, src)
    sdf = st.read_stream(spark, src, e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out, ckpt = st.stream_dirs(spark, "x01")
    dedup = st.stream_ingest_dedup(sdf, ["event_id"], "ts", "1 day")
    st.run_available(dedup.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt), spark)
    return spark.read.parquet(out).select("event_id", "event_type", "value", F.to_date("ts").alias("d"))


@query("X02_stream_upsert", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 20 ELSE c_acctbal END AS c_acctbal FROM customer
""")
def x02(spark, sf):
    """Customer versions arrive as files; each micro-batch upserts into a new snapshot."""
    c = table(spark, sf, "customer")
    src = scratch_path(spark, "x02-landing")
    _land(c.select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("seq")), src)
    changed = c.filter(F.col("c_mktsegment") == "MACHINERY")
    _land(changed.select("c_custkey", "c_name", (F.col("c_acctbal") + 10).alias("c_acctbal"), F.lit(1).alias("seq")), src)
    _land(changed.select("c_custkey", "c_name", (F.col("c_acctbal") + 20).alias("c_acctbal"), F.lit(2).alias("seq")), src)
    schema = "c_custkey bigint, c_name string, c_acctbal double, seq int"
    sdf = st.read_stream(spark, src, schema, max_files=1)
    target, ckpt = st.stream_dirs(spark, "x02")
    st.run_available(st.stream_upsert(sdf, target, ["c_custkey"], "seq", ckpt), spark)
    return st.read_latest_snapshot(spark, target, schema).select("c_custkey", "c_name", "c_acctbal")


@query("X02_stream_upsert_partitions", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 20 ELSE c_acctbal END AS c_acctbal,
  c_mktsegment FROM customer
""")
def x02_partitions(spark, sf):
    """Customer versions arrive as files; each micro-batch rewrites only the segment partitions it touches."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    src = scratch_path(spark, "x02p-landing")
    _land(c.withColumn("seq", F.lit(0)), src)
    changed = c.filter(F.col("c_mktsegment") == "MACHINERY")
    _land(changed.withColumn("c_acctbal", F.col("c_acctbal") + 10).withColumn("seq", F.lit(1)), src)
    _land(changed.withColumn("c_acctbal", F.col("c_acctbal") + 20).withColumn("seq", F.lit(2)), src)
    schema = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string, seq int"
    sdf = st.read_stream(spark, src, schema, max_files=1)
    target, ckpt = st.stream_dirs(spark, "x02p")
    st.run_available(st.stream_upsert(sdf, target, ["c_custkey"], "seq", ckpt, partition_by=["c_mktsegment"]), spark)
    return st.read_sink(spark, target, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string") \
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("X03_stream_bucket_count", """
SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS count FROM events GROUP BY 1, 2
""")
def x03(spark, sf):
    """Tumbling one-day windows by type under a watermark; update-mode batches logged, latest kept."""
    e = table(spark, sf, "events")
    src = scratch_path(spark, "x03-landing")
    weeks = [r[0] for r in e.select(F.date_trunc("week", "ts").alias("w")).distinct().orderBy("w").collect()]  # calendar-bounded
    out, ckpt = st.stream_dirs(spark, "x03")
    chunks = _chunks(weeks, 3) or [[]]
    part = F.lit(0)
    for i, chunk in enumerate(chunks[1:], 1):
        part = F.when(F.date_trunc("week", "ts") >= F.lit(chunk[0]), F.lit(i)).otherwise(part)
    staged = scratch_path(spark, "x03-staged")
    e.withColumn("part", part).write.partitionBy("part").parquet(staged)  # one scan of the table for all landings
    for i in range(len(chunks)):  # land in time order, so no row arrives behind the watermark
        _land(st.read_sink(spark, f"{staged}/part={i}", e.schema), src)
        # one micro-batch a landing: the watermark moves between landings, never between the files of one
        sdf = st.read_stream(spark, src, e.schema, max_files=None).withColumn("ts", F.col("ts").cast("timestamp"))
        st.run_available(st.sink_updates(st.stream_bucket_count(sdf, "ts", ["event_type"], "1 day", "1 day"), out, ckpt), spark)
    res = st.read_updates(spark, out, ["window_start", "event_type"],
                          "window_start timestamp, window_end timestamp, event_type string, count bigint, batch int")
    return res.select(F.to_date("window_start").alias("d"), "event_type", "count")


SQL_CHANGE_POINTS = f"""
WITH RECURSIVE s AS (SELECT l_returnflag, sd, CAST(n_lines AS DOUBLE) AS v,
                            row_number() OVER (PARTITION BY l_returnflag ORDER BY sd) AS rn FROM ({SQL_DAILY_QTY_FLAG})),
r AS (SELECT l_returnflag, rn, sd, v, v AS last, true AS emit FROM s WHERE rn = 1
      UNION ALL
      SELECT s.l_returnflag, s.rn, s.sd, s.v,
        CASE WHEN abs(s.v - r.last) > {THRESHOLD} OR r.last < 0 THEN s.v ELSE r.last END,
        abs(s.v - r.last) > {THRESHOLD} OR r.last < 0
      FROM r JOIN s ON s.l_returnflag = r.l_returnflag AND s.rn = r.rn + 1)
SELECT l_returnflag, sd, v AS n_lines FROM r WHERE emit
"""


@query("X04_stream_change_points", SQL_CHANGE_POINTS)
def x04(spark, sf):
    """Daily line counts per return flag arrive year by year; the last emitted value per
    series is stream state, so change points continue across micro-batches."""
    rollup = daily_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", F.col("n_lines").cast("double").alias("n_lines"))
    snap = scratch_path(spark, "x04-rollup")
    _land(rollup, snap)  # computed once; the yearly slices below read this small snapshot
    d = spark.read.parquet(snap)
    src = scratch_path(spark, "x04-landing")
    years = [r[0] for r in d.select(F.year("sd")).distinct().orderBy(F.year("sd")).collect()]  # calendar years, bounded
    for chunk in _chunks(years, 3):  # land in time order: three consecutive year ranges, one micro-batch each
        _land(d.filter(F.year("sd").isin(chunk)).coalesce(1), src)
    if not years:
        _land(d, src)  # an empty landing still creates the folder
    sdf = st.read_stream(spark, src, d.schema, max_files=1)
    cp = st.stream_change_points(sdf, "l_returnflag", "sd", "n_lines", THRESHOLD)
    out, ckpt = st.stream_dirs(spark, "x04")
    st.run_available(cp.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt), spark)
    return st.read_sink(spark, out, "l_returnflag string, sd date, n_lines double")


@query("X04_stream_change_points_shuffled", SQL_CHANGE_POINTS)
def x04_shuffled(spark, sf):
    """The same rows land out of order, up to nine days late and in four files of one
    micro-batch each: held until the watermark passes, they give the batch result."""
    rollup = daily_qty(spark, sf, by_flag=True).select("l_returnflag", "sd", F.col("n_lines").cast("double").alias("n_lines"))
    snap = scratch_path(spark, "x04s-rollup")
    _land(rollup, snap)
    d = spark.read.parquet(snap)
    src = scratch_path(spark, "x04s-landing")
    landed = F.year(F.date_add("sd", F.pmod(F.hash("sd", "l_returnflag"), F.lit(10))))
    years = [r[0] for r in d.select(landed.alias("y")).distinct().orderBy("y").collect()]  # calendar years, bounded
    for chunk in _chunks(years, 3):
        _land(d.filter(landed.isin(chunk)).orderBy(F.hash("sd", "n_lines")).coalesce(1), src)
    # a day far ahead, of no series: the watermark passes all rows
    last = spark.range(1).select(F.lit(None).cast("string").alias("l_returnflag"), F.lit("2100-01-01").cast("date").alias("sd"),
                                 F.lit(None).cast("double").alias("n_lines"))
    _land(last.select(*d.columns), src)
    out, ckpt = st.stream_dirs(spark, "x04s")
    with st.use_rocksdb(spark):
        sdf = st.read_stream(spark, src, d.schema, max_files=1)
        cp = st.stream_change_points_late(sdf, "l_returnflag", "sd", "n_lines", THRESHOLD, delay="10 days")
        st.run_available(cp.writeStream.outputMode("append").format("parquet").option("path", out)
                         .option("checkpointLocation", ckpt), spark)
    return st.read_sink(spark, out, "l_returnflag string, sd date, n_lines double").filter("l_returnflag IS NOT NULL")
