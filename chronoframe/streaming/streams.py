"""Streaming forms of the incremental operators.

The reference loads daily batches with high-water marks and idempotent
writes; in Structured Streaming the same jobs are a file-source stream with
a watermark, exactly-once sinks and checkpointed state. The runners use
``trigger(availableNow=True)`` so a run over landed files is finite; state
and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from chronoframe.operators.loads import upsert, upsert_partitions
from chronoframe.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


# X01
def stream_ingest_dedup(sdf: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated keys seen within the watermark delay (state is bounded
    by the delay, not by history)."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# X02
def stream_upsert(sdf: DataFrame, target_path: str, keys: Sequence[str], order: str, checkpoint: str,
                  partition_by: Sequence[str] = (), keep: int = 2):
    """Micro-batch upsert.

    Without ``partition_by``: batch ``k`` merges into the latest snapshot with
    a smaller batch id and writes snapshot ``batch=k``; a replayed batch reads
    the same predecessor and overwrites its own directory. Each batch rewrites
    the table, so this form is for small ones. The last ``keep`` snapshots stay
    (2 at least: a replay needs the predecessor, a reader the newest); older
    ones are removed when a newer one is complete.

    With ``partition_by`` (the scalable form): each batch is merged into one
    partitioned table, rewriting only the partitions it touches
    (``upsert_partitions``); the first batch creates the table. Replays are
    idempotent because the last row per key wins either way."""
    spark = sdf.sparkSession
    if partition_by:
        def merge_partitions(batch: DataFrame, batch_id: int) -> None:
            staging = f"{checkpoint.rstrip('/')}/staging/{batch_id:09d}-{uuid.uuid4().hex[:8]}"
            try:
                spark.read.parquet(target_path)
            except AnalysisException as e:  # first batch: create the table
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                first = upsert(batch.limit(0), batch, keys, order).drop(order)
                first.write.mode("overwrite").partitionBy(*partition_by).parquet(target_path)
                return
            upsert_partitions(target_path, batch, keys, order, list(partition_by), staging)

        return sdf.writeStream.foreachBatch(merge_partitions).option("checkpointLocation", checkpoint)

    def merge(batch: DataFrame, batch_id: int) -> None:
        out = f"{target_path}/batch={batch_id:09d}"
        current = batch.limit(0)
        try:
            prev = spark.read.parquet(target_path).filter(F.col("batch") < batch_id)
        except AnalysisException as e:  # nothing committed yet: the target folder does not exist
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            prev = None
        if prev is not None:
            cur_id = prev.agg(F.max("batch")).first()[0]
            if cur_id is not None:
                current = prev.filter(F.col("batch") == cur_id).drop("batch")
        upsert(current, batch.select(*current.columns), keys, order).write.mode("overwrite").parquet(out)
        remove_old_snapshots(spark, target_path, batch_id, max(keep, 2))

    return sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def remove_old_snapshots(spark: SparkSession, target_path: str, newest: int, keep: int) -> list[str]:
    """Delete the folders ``batch=<id>`` up to ``newest`` but the last ``keep``; returns their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target_path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory())
    old = [n for n in found if n.startswith("batch=") and int(n[6:]) <= newest][:-keep]
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return old


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream's file sink, or an empty frame of ``schema`` when no batch has
    written anything yet (no input files)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_latest_snapshot(spark: SparkSession, target_path: str, schema=None) -> DataFrame:
    if schema is not None:
        snap = read_sink(spark, target_path, f"{schema}, batch int" if isinstance(schema, str) else schema)
    else:
        snap = spark.read.parquet(target_path)
    return snap.filter(F.col("batch") == snap.select(F.max("batch")).scalar()).drop("batch")


# X03
def stream_bucket_count(sdf: DataFrame, ts: str, dims: Sequence[str], size: str = "1 day", delay: str = "1 day",
                        value: str | None = None) -> DataFrame:
    """Tumbling-window count (and sum) by category under a watermark."""
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.sum(value).alias("total")] if value else [])
    measures = ["count"] + (["total"] if value else [])
    agg = sdf.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *dims).agg(*aggs)
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *dims, *measures)


def sink_updates(agg: DataFrame, path: str, checkpoint: str):
    """Update-mode aggregate → a log of updated rows, one directory per batch
    id (overwritten on replay, so a re-run batch never duplicates rows);
    ``read_updates`` keeps the latest version of each key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_updates(spark: SparkSession, path: str, keys: Sequence[str], schema=None) -> DataFrame:
    log = read_sink(spark, path, schema) if schema is not None else spark.read.parquet(path)
    cols = [c for c in log.columns if c not in keys and c != "batch"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("__r")).select(*keys, "__r.*")


# X04
def stream_change_points(sdf: DataFrame, series: str, order: str, value: str, threshold: float = 10.0) -> DataFrame:
    """Emit a row when it differs by more than ``threshold`` from the last
    emitted value of its series; the last emitted value is the per-series
    state (rows of a series are assumed to arrive in order)."""
    out_schema = f"`{series}` string, `{order}` date, `{value}` double"

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get[0] if state.exists else -1.0
        frames = [p for p in pdfs]
        pdf = pd.concat(frames).sort_values(order, kind="mergesort") if frames else pd.DataFrame()
        keep = []
        for i, x in enumerate(pdf[value].astype("float64").to_numpy() if len(pdf) else []):
            if abs(x - prev) > threshold or prev < 0:
                keep.append(i)
                prev = float(x)
        state.update((prev,))
        if keep:
            yield pdf.iloc[keep][[series, order, value]].astype({value: "float64"})

    src = sdf.select(F.col(series).cast("string").alias(series), order, F.col(value).cast("double").alias(value))
    return src.groupBy(series).applyInPandasWithState(step, out_schema, "last double", "append", GroupStateTimeout.NoTimeout)


DAY_MS = 86_400_000


class _HeldRows(StatefulProcessor):
    """Rows of a series wait in list state until the watermark passes their day.
    One timer, at the first day that waits, then takes all rows that are due, in
    order, past the last emitted value."""

    def __init__(self, names: Sequence[str], threshold: float, idle_days: int | None) -> None:
        self.names, self.threshold, self.idle_days = list(names), threshold, idle_days

    def init(self, handle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "d long, v double")
        self.last = handle.getValueState("last", "v double, d long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            d = pd.to_datetime(pdf["held_time"]).astype("datetime64[ms]").astype("int64") // DAY_MS
            got = list(zip(d.tolist(), pdf["held_value"].astype("float64").tolist(), strict=True))
            self.early.appendList(got)
            first = int(d.min()) if first is None else min(first, int(d.min()))
        if first is not None:
            self.handle.registerTimer(first * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = [(int(d), float(v)) for d, v in self.early.get()] if self.early.exists() else []
        due = sorted(r for r in held if r[0] <= now)
        last, at = self.last.get() if self.last.exists() else (-1.0, None)
        if not due:
            if self.idle_days is not None and not held and at is not None and now - at >= self.idle_days:
                self.last.clear()  # an idle series is forgotten: its next row starts anew
            return
        out = []
        for d, v in due:
            if abs(v - last) > self.threshold or last < 0:
                out.append((d, v))
                last = v
        rest = [r for r in held if r[0] > now]
        if rest:
            self.early.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) * DAY_MS)
        else:
            self.early.clear()
        self.last.update((last, due[-1][0]))
        if self.idle_days is not None:
            self.handle.registerTimer((due[-1][0] + self.idle_days) * DAY_MS)
        if out:
            yield pd.DataFrame({self.names[0]: [key[0]] * len(out),
                                self.names[1]: [pd.Timestamp(d * DAY_MS, unit="ms").date() for d, _ in out],
                                self.names[2]: [v for _, v in out]})

    def close(self) -> None:
        pass


def stream_change_points_late(sdf: DataFrame, series: str, order: str, value: str, threshold: float = 10.0,
                              delay: str = "7 days", idle_days: int | None = None) -> DataFrame:
    """As ``stream_change_points`` for rows that arrive in any order: a row is
    judged when the watermark (the latest day less ``delay``) has passed its
    day, behind all earlier rows of its series, so the result is that of the
    batch operator W15. State holds the rows within ``delay`` and one value a
    series; a series without rows for ``idle_days`` is forgotten. Rows later
    than the watermark are dropped, as by any watermark. Needs the RocksDB
    state store (``use_rocksdb``)."""
    src = sdf.select(F.col(series).cast("string").alias(series), F.col(order).cast("timestamp").alias("held_time"),
                     F.col(value).cast("double").alias("held_value")).withWatermark("held_time", delay)
    return src.groupBy(series).transformWithStateInPandas(
        _HeldRows([series, order, value], threshold, idle_days), f"`{series}` string, `{order}` date, `{value}` double",
        "append", "EventTime")


@contextmanager
def use_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start streams with the RocksDB state store, which state of several variables needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


def run_available(writer, spark: SparkSession) -> None:
    """Run a stream over all files present now, however long that takes."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/_checkpoint"
