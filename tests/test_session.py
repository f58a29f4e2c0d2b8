"""Scratch space and lineage cuts use the shared checkpoint folder."""

from __future__ import annotations

from chronoframe.session import checkpoint_root, cut_lineage, scratch_path
from tests.conftest import SF_SMALL
from tests.plan_util import plan_text


def test_scratch_paths_live_under_the_checkpoint_dir(spark):
    root = spark.sparkContext.getCheckpointDir()
    assert root and checkpoint_root(spark) == root
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(root.rstrip("/") + "/") and a != b  # fresh, never reused


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").groupBy("o_orderstatus").count()
    cut = cut_lineage(df)
    plan = plan_text(cut, "simple")
    assert "FileScan" not in plan and "HashAggregate" not in plan  # lineage truncated
    assert sorted(cut.collect()) == sorted(df.collect())
