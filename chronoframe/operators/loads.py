"""Sinks, incremental loads and orchestration-as-data.

A load is a pure function ``(target, batch) -> new snapshot`` built lazily
from DataFrames; ``write_snapshot`` commits it to a fresh directory (never
the path being read), so a failed or retried job leaves the previous
snapshot intact. Scalars that steer a load (a high-water mark, the batch's
minimum date, "is the batch empty") are scalar subqueries, not driver
round trips.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, MapType, StructType

from chronoframe.functions.common import as_col, last_of_key
from chronoframe.functions.dates import int_to_date
from chronoframe.operators.keyfilter import flag_possible, possible_keys
from chronoframe.session import scratch_path


EXPORTS_AT_ONCE = 8


def _k(keys) -> list:
    return [keys] if isinstance(keys, str) else list(keys)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Commit a snapshot to ``path`` (a fresh directory) and return the path."""
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def commit_append(delta: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Append only the new rows (an append-ignore or high-water-mark delta) to
    a table directory: existing files are never rewritten, so the cost of a
    load is the size of the batch, not of the table."""
    w = delta.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def commit_partitions(df: DataFrame, path: str, partition_by: Sequence[str], staging: str) -> str:
    """Replace exactly the partitions present in ``df`` (dynamic partition
    overwrite); all other partitions stay untouched. ``df`` is first
    materialised in ``staging`` (a fresh directory) so the job that rewrites
    the partitions never reads the files it replaces."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(staging)
    staged = df.sparkSession.read.schema(df.schema).parquet(staging)  # declared: an empty merge writes no files
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path


# K01
def sink_json(df: DataFrame, path: str) -> str:
    """JSON lines; dates as ISO text, decimals as doubles, at any depth of
    structs, arrays and map values. A one-row frame (K03) is a single document."""
    sink_json_counted(df, path)
    return path


def sink_json_counted(df: DataFrame, path: str) -> int:
    """As ``sink_json``; returns the number of rows, observed by the writing job itself."""
    seen = Observation()
    json_ready(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").json(path)
    return seen.get.get("rows", 0)  # a frame that the optimizer knows to be empty has nothing to observe


def json_ready(df: DataFrame) -> DataFrame:
    """``df`` with the values ``sink_json`` writes."""
    return df.select(*[_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _json_value(c: Column, t: DataType) -> Column:
    if isinstance(t, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, DecimalType):
        return c.cast("double")
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_value(c.getField(f.name), f.dataType).alias(f.name) for f in t]))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _json_value(x, t.elementType))
    if isinstance(t, MapType):
        return F.transform_values(c, lambda _, v: _json_value(v, t.valueType))
    return c


# K02
def assign_periods(df: DataFrame, int_date: str, periods: Mapping[str, tuple]) -> DataFrame:
    """Tag rows with every named, inclusive period they fall in (overlaps
    allowed); rows outside all periods drop. The period list is a literal
    array filtered per row and exploded — no join, no nested loop."""
    d = as_col(int_date)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(int(lo)).alias("lo"), F.lit(int(hi)).alias("hi"))
                      for n, (lo, hi) in periods.items()])
    hits = F.filter(table, lambda p: (d >= p["lo"]) & (d <= p["hi"]))
    return df.withColumn("period", F.explode(F.transform(hits, lambda p: p["name"])))


def sink_period_partitions(df: DataFrame, int_date: str, periods: Mapping[str, tuple], path: str) -> str:
    """One output partition per period (an empty period writes nothing)."""
    assign_periods(df, int_date, periods).write.mode("errorifexists").partitionBy("period").parquet(path)
    return path


# K03
def nested_document(parts: Mapping[str, tuple]) -> DataFrame:
    """``{section: (df, {name: agg Column})}`` → one row with one struct per
    section. One aggregate per table (one scan each); the first is the row,
    the others attach as scalar subqueries (no join)."""
    out = None
    for section, (df, aggs) in parts.items():
        row = df.agg(F.struct(*[e.alias(n) for n, e in aggs.items()]).alias(section))
        out = row if out is None else out.withColumn(section, row.scalar())
    return out


# K04
def append_ignore(target: DataFrame, batch: DataFrame, keys, order: str) -> DataFrame:
    """``INSERT … ON CONFLICT DO NOTHING``: the first batch row per key (by
    ``order``) is kept, keys already in the target are skipped. Dedupe is a
    ``min_by`` aggregation, so a key repeated in a third of the batch is
    reduced map-side instead of sorted in one task."""
    k = _k(keys)
    cols = [c for c in batch.columns if c not in k]
    first = batch.groupBy(*k).agg(F.min_by(F.struct(*cols), as_col(order)).alias("__r")).select(*k, "__r.*")
    fresh = first.join(possible_keys(target, first, k), k, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def append_ignore_delta(target: DataFrame, batch: DataFrame, keys, order: str) -> DataFrame:
    """Only the rows ``append_ignore`` would add (first per new key)."""
    k = _k(keys)
    cols = [c for c in batch.columns if c not in k]
    first = batch.groupBy(*k).agg(F.min_by(F.struct(*cols), as_col(order)).alias("__r")).select(*k, "__r.*")
    return first.join(possible_keys(target, first, k), k, "left_anti").select(*target.columns)


def _is_empty(df: DataFrame) -> Column:
    return df.select(F.lit(1).alias("x")).limit(1).select(F.count(F.lit(1))).scalar() == 0


# K05
def truncate_load(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Full replace; an empty batch leaves the target as it is."""
    empty = _is_empty(batch)
    return target.filter(empty).unionByName(batch.select(*target.columns))


# K06
def delete_range_load(target: DataFrame, batch: DataFrame, date: str) -> DataFrame:
    """Delete ``date >= min(batch.date)``, then insert the batch; rows newer
    than the batch maximum disappear too (as in the reference). Empty batch →
    no-op."""
    lo = batch.select(F.min(date)).scalar()
    return target.filter(lo.isNull() | (as_col(date) < lo)).unionByName(batch.select(*target.columns))


# K07
def upsert(target: DataFrame, batch: DataFrame, keys, order: str) -> DataFrame:
    """Insert-or-update by key; the last batch row per key (by ``order``) wins.
    Target rows whose key the batch certainly lacks go straight from the scan
    to the result; only the others are compared by key."""
    k = _k(keys)
    cols = [c for c in batch.columns if c not in k]
    last = batch.groupBy(*k).agg(F.max_by(F.struct(*cols), as_col(order)).alias("__r")).select(*k, "__r.*")
    flagged = flag_possible(target, last, k)
    kept = flagged.filter("NOT __possible").drop("__possible").unionByName(
        flagged.filter("__possible").drop("__possible").join(last.select(*k), k, "left_anti"))
    return kept.unionByName(last.select(*target.columns))


def upsert_partitions(target_path: str, batch: DataFrame, keys, order: str, partition_by: Sequence[str],
                      staging: str, schema=None) -> str:
    """Upsert touching only the partitions the batch lands in. The touched
    partition values select the target partitions (a semi join on partition
    columns, pruned at the scan by dynamic partition pruning), those are
    merged with ``upsert`` and written back with a dynamic partition
    overwrite. Requires the partition columns to be a function of the key
    (a key never moves between partitions)."""
    spark = batch.sparkSession
    reader = spark.read.schema(schema) if schema is not None else spark.read
    target = reader.parquet(target_path)  # pass ``schema`` when the table may hold no files yet
    touched = batch.select(*partition_by).distinct()
    current = target.join(touched, list(partition_by), "left_semi")
    merged = upsert(current, batch.select(*target.columns, *([order] if order not in target.columns else [])),
                    keys, order)
    return commit_partitions(merged, target_path, partition_by, staging)


# K08
def update_from(target: DataFrame, side: DataFrame, keys, column: str, side_column: str | None = None,
                order=None) -> DataFrame:
    """``UPDATE t SET col = s.col FROM s WHERE key``: matched rows take the
    side value (even NULL), unmatched keep theirs. Of several side rows with
    one key the last by ``order`` (a column or expression) counts; without an
    order, several side rows for a key are an error."""
    k = _k(keys)
    sc = side_column or column
    s = side.groupBy(*k).agg(last_of_key(sc, order).alias("__new")).withColumn("__hit", F.lit(True))
    j = target.join(s, k, "left")  # aggregated side: AQE broadcasts it when small
    return j.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).select(*target.columns)


# K09
def high_water_mark(target: DataFrame, batch: DataFrame, date: str, default=None, target_date: str | None = None) -> DataFrame:
    """Batch rows strictly after ``max(target.date)`` (``default`` when the
    target is empty)."""
    hwm = target.select(F.max(target_date or date)).scalar()
    if default is not None:
        hwm = F.coalesce(hwm, F.lit(default).cast(dict(batch.dtypes)[date]))
    return batch.filter(as_col(date) > hwm)


# K10
def refresh_if_newer(target: DataFrame, batch: DataFrame, year: str) -> DataFrame:
    """Full replace only if ``max(batch.year) > max(target.year)`` (NULL → 0)."""
    newer = batch.select(F.max(year)).scalar() > F.coalesce(target.select(F.max(year)).scalar(), F.lit(0))
    newer = F.coalesce(newer, F.lit(False))
    return target.filter(~newer).unionByName(batch.select(*target.columns).filter(newer))


# K11
def chunk_range(bounds: DataFrame, start: str, end: str, days: int = 90) -> DataFrame:
    """Cut each [start, end] row into ``days``-long closed chunks."""
    s = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {int(days)} DAYS"))).alias("chunk_start")
    res = bounds.select(s, F.col(end).alias("__end"))
    return res.select("chunk_start", F.least(F.date_add("chunk_start", days - 1), F.col("__end")).alias("chunk_end"))


def dataset_stats(frames: Mapping[str, tuple]) -> DataFrame:
    """``{key: (df, date_col or None)}`` → (key, max_date, count), one aggregate per table."""
    out = None
    for key, (df, date) in frames.items():
        md = F.max(F.to_date(as_col(date))) if date else F.lit(None).cast("date")
        row = df.agg(md.alias("max_date"), F.count(F.lit(1)).alias("count")).select(F.lit(key).alias("key"), "max_date", "count")
        out = row if out is None else out.unionByName(row)
    return out


# K12
def detect_changes(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Changed when max_date or count differs (NULL-safe); missing baseline →
    changed; count-only datasets compare the count."""
    b = baseline.select("key", F.col("max_date").alias("b_max_date"), F.col("count").alias("b_count"))
    j = stats.join(b, "key", "left")
    reason = (F.when(F.col("b_count").isNull(), "new")
              .when(~F.col("count").eqNullSafe(F.col("b_count")), "count")
              .when(~F.col("max_date").eqNullSafe(F.col("b_max_date")), "max_date")
              .otherwise("unchanged"))
    return j.select("key", (reason != "unchanged").alias("changed"), reason.alias("reason"))


# K13
def affected_outputs(changes: DataFrame, mapping: DataFrame, always: Sequence[str] = ()) -> DataFrame:
    """Outputs to re-export: those mapped from changed datasets, plus ``always``."""
    hit = changes.filter("changed").select("key")
    outs = mapping.join(hit, "key", "left_semi").select("output")
    if always:
        outs = outs.unionByName(mapping.sparkSession.createDataFrame([(a,) for a in always], "output string"))
    return outs.distinct()


def export_outputs(outputs: Mapping[str, DataFrame], base: str, only=None) -> DataFrame:
    """Write the named rollups as JSON (K01) under ``base/<name>`` — all of
    them, or only those in ``only`` (the affected outputs of K13) — and
    return a manifest (output, path, rows). Outputs are independent, so their
    jobs are submitted side by side, ``EXPORTS_AT_ONCE`` at a time, and share
    the cluster; each job counts the rows that it writes. An output that fails
    fails the export once the others have ended."""
    chosen = {k: v for k, v in outputs.items() if only is None or k in set(only)}
    spark = next(iter(outputs.values())).sparkSession
    paths = {name: f"{base.rstrip('/')}/{name}" for name in chosen}
    with ThreadPoolExecutor(max_workers=EXPORTS_AT_ONCE) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(spark)(sink_json_counted), df, paths[name])
                for name, df in chosen.items()}
    manifest = [(name, paths[name], job.result()) for name, job in jobs.items()]
    return spark.createDataFrame(manifest, "output string, path string, rows long")


def export_changed(stats: DataFrame, baseline_path: str, mapping: DataFrame, outputs: Mapping[str, DataFrame], base: str,
                   new_baseline_path: str, always: Sequence[str] = ()) -> DataFrame:
    """One export run against a stored baseline: compare ``stats`` with it,
    write the affected outputs, and only then store ``stats`` as the next
    run's baseline (a fresh directory). Returns the manifest. A run that
    fails leaves the old baseline, so the next one exports the same again;
    without a change nothing but ``always`` is written."""
    spark = stats.sparkSession
    baseline = spark.read.schema(stats.schema).parquet(baseline_path)
    affected = [r[0] for r in affected_outputs(detect_changes(stats, baseline), mapping, always).collect()]  # output names
    manifest = export_outputs(outputs, base, only=affected)
    write_snapshot(stats, new_baseline_path)
    return manifest


# K14
def refresh_rollup(df: DataFrame, series, date: str, value: str) -> DataFrame:
    """Recompute a daily rollup with ``change`` and ``change_pct`` vs the
    previous row of the series."""
    from pyspark.sql.window import Window
    k = [series] if isinstance(series, str) else list(series)
    w = (Window.partitionBy(*k) if k else Window).orderBy(date)
    prev = F.lag(value).over(w)
    res = df.withColumn("__p", prev).withColumn("change", as_col(value) - F.col("__p"))
    pct = F.when(F.col("__p") != 0, F.col("change") / F.col("__p") * 100.0)
    return res.withColumn("change_pct", pct).drop("__p")


def decode_max_date(df: DataFrame, col: str) -> Column:
    """Max of a date-ish column as DATE, decoding by type: bigint
    ``YYYYMMDDHHMMSS`` (> 99,999,999), int ``YYYYMMDD`` (> 9,999), year (> 0),
    timestamp, date, or text whose first 10 chars are ISO."""
    t = dict(df.dtypes)[col]
    m = F.max(col)
    if t in ("int", "bigint", "smallint", "tinyint"):
        v = m.cast("long")
        day14 = ((v - F.pmod(v, F.lit(1000000))) / F.lit(1000000)).cast("long")
        return (F.when(v > 99999999, int_to_date(day14))
                .when(v > 9999, int_to_date(v))
                .when(v > 0, F.make_date(v.cast("int"), F.lit(1), F.lit(1))))
    if t in ("date", "timestamp", "timestamp_ntz"):
        return F.to_date(m)
    return F.try_to_date(F.substring(m.cast("string"), 1, 10), "yyyy-MM-dd")


# K15
def staleness_report(frames: Mapping[str, tuple], as_of) -> DataFrame:
    """Per table: rows, decoded max date, days stale against ``as_of``."""
    out = None
    for name, (df, col) in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), decode_max_date(df, col).alias("max_date"))
        row = row.select(F.lit(name).alias("table_name"), "rows", "max_date",
                         F.datediff(F.lit(as_of).cast("date"), F.col("max_date")).alias("days_stale"))
        out = row if out is None else out.unionByName(row)
    return out


def human_count(c) -> Column:
    """``596`` / ``2.5K`` / ``55.6M`` formatting of a row count."""
    c = as_col(c).cast("double")
    return (F.when(c >= 1e6, F.concat(F.format_number(F.round(c / 1e6, 1), 1), F.lit("M")))
            .when(c >= 1e3, F.concat(F.format_number(F.round(c / 1e3, 1), 1), F.lit("K")))
            .otherwise(c.cast("long").cast("string")))


# K16
def inventory(frames: Mapping[str, DataFrame], source_of: Mapping[str, str]) -> DataFrame:
    """Per table (source, name, rows, formatted rows) plus one total row per
    source (``table_name = '*'``)."""
    per = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(source_of.get(name, name)).alias("source"), F.lit(name).alias("table_name"), "row_count")
        per = row if per is None else per.unionByName(row)
    totals = per.groupBy("source").agg(F.sum("row_count").alias("row_count")).select("source", F.lit("*").alias("table_name"), "row_count")
    both = per.unionByName(totals)
    return both.withColumn("formatted", F.regexp_replace(human_count("row_count"), ",", ""))


# K17
def region_rollup_load(df: DataFrame, region: str, ts_text, measures: Sequence[str], meta: Sequence[str] = (),
                       order: str | None = None) -> DataFrame:
    """API grain → (region, date) sums with missing → 0, date = first 10 chars;
    metadata from the first-seen row per group (least ``order``, ties by the
    metadata itself). The raw rows are summed by hash per (region, date,
    metadata), with the least order of each; only that small rollup is
    compared row by row. ``order`` should be of fixed width (number, date,
    decimal) for the hash aggregate."""
    d = F.try_to_date(F.substring(as_col(ts_text).cast("string"), 1, 10), "yyyy-MM-dd")
    src = df.withColumn("date", d)
    sums = [F.sum(F.coalesce(as_col(m), F.lit(0))).alias(m) for m in measures]
    if not meta:
        return src.groupBy(region, "date").agg(*sums)
    seen = F.min(as_col(order)) if order else F.lit(0)
    fine = src.groupBy(region, "date", *meta).agg(*sums, seen.alias("__seen"))
    rank = F.when(F.col("__seen").isNotNull(), F.struct("__seen", *meta))
    return fine.groupBy(region, "date").agg(*[F.sum(m).alias(m) for m in measures],
                                            *[F.min_by(F.col(m), rank).alias(m) for m in meta])


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
