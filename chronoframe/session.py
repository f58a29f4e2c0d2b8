"""Session helpers: builder defaults, shared scratch space, size-bounded broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 32 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "chronoframe") -> SparkSession:
    """Session used by tests and the bench. On a cluster the submitter's
    session is used as is; nothing here is required by the operators."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone so date bucketing is reproducible."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) a private
    directory is created and registered, so cluster jobs never fall back
    to a machine-local folder silently.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="chronoframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused directory under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/chronoframe/{name}-{uuid.uuid4().hex[:12]}"


def local_dir(path: str) -> str:
    """Strip a ``file:`` scheme for the few helpers that write with Python
    I/O (test fixtures only)."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    os.makedirs(path, exist_ok=True)
    return path


def broadcast_below(df: DataFrame, size: int, limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for a side whose ``size`` in bytes is known without a
    job (e.g. from the file listing); above ``limit`` the planner decides.
    All other sides are left to the planner and AQE, which broadcast below
    ``spark.sql.autoBroadcastJoinThreshold``."""
    return F.broadcast(df) if size <= limit else df


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)
