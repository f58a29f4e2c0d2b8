"""Physical-plan assertions: pushdown, pruning, broadcast of dictionaries,
no cartesian products, Python only where the semantics are sequential."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.plan_util import plan_text

QUERIES = entry.queries()
# Operators whose per-group state is inherently sequential or whose input is an archive.
PYTHON_OK = {"W15_change_points", "X04_stream_change_points",
             "W13_rolling_median_wide"}  # a list that slides over wide windows


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_text(f(spark, SF_SMALL), "simple") for k, f in QUERIES.items()}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {k for k, t in plans.items() if "CartesianProduct" in t or "BroadcastNestedLoopJoin" in t}
    assert bad == set()


def test_python_only_where_needed(plans):
    py = {k for k, t in plans.items() if any(w in t for w in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                                                              "MapInPandas", "FlatMapGroupsInPandasWithState"))}
    assert py <= PYTHON_OK


def test_scan_pushdown_and_pruning(spark):
    t = plan_text(QUERIES["S01_scan_table"](spark, SF_SMALL))
    assert "PushedFilters" in t and "o_orderstatus" in t.split("PushedFilters")[1].split("\n")[0]
    schema = t.split("ReadSchema:")[1].split("\n")[0]
    assert "o_orderpriority" not in schema and "o_orderdate" not in schema


def test_dictionary_is_broadcast(spark):
    t = plan_text(QUERIES["P03_dict_label"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in t


def test_grouped_aggregates_are_partial_before_shuffle(spark):
    t = plan_text(QUERIES["A05_group_count_sum"](spark, SF_SMALL), "simple")
    assert "partial_count" in t and "Exchange hashpartitioning" in t


def test_loads_dedupe_by_aggregation_not_window(spark):
    t = plan_text(QUERIES["K07_upsert"](spark, SF_SMALL), "simple")
    assert "Window" not in t


def test_region_rollup_sums_raw_rows_by_hash(spark):
    """Raw lines meet a hash aggregate first; only its result is compared row by row."""
    lines = plan_text(QUERIES["K17_region_rollup_load"](spark, SF_SMALL), "simple").splitlines()
    kinds = [ln.lstrip(" :+-").split("(")[0] for ln in lines if "Aggregate(" in ln]
    assert kinds[-1] == "HashAggregate" and "partial_sum" in [ln for ln in lines if "HashAggregate(" in ln][-1]


def test_merged_series_scan_their_table_once(spark):
    for name in ("J03_date_merge_fill", "A30_correlation_matrix"):
        assert plan_text(QUERIES[name](spark, SF_SMALL), "simple").count("FileScan parquet") == 1


def test_latest_values_without_a_single_task_window(plans):
    for name in ("W07_running_total", "W19_latest_per_series", "W20_top_n_latest_year"):
        assert "Window [" not in plans[name].replace("Window [sum(", "")


def _unpartitioned_windows_over_raw_rows(plan: str) -> list[str]:
    """Window nodes with an empty partition spec whose input reaches a scan
    without passing through an aggregate or a top-k."""
    lines = [ln for ln in plan.splitlines() if ln.strip()]
    bad = []
    for i, ln in enumerate(lines):
        stripped = ln.lstrip(" :+-")
        if not stripped.startswith("Window ["):
            continue
        # second bracket group is the partition spec
        depth, groups, cur = 0, [], ""
        for ch in stripped[len("Window "):]:
            if ch == "[":
                depth += 1
                if depth == 1:
                    cur = ""
                    continue
            if ch == "]":
                depth -= 1
                if depth == 0:
                    groups.append(cur)
                    continue
            if depth >= 1:
                cur += ch
        # explain prints "Window [exprs], [partition], [order]", and drops the
        # partition group entirely when there is none
        partitioned = len(groups) >= 3 and groups[1].strip()
        if partitioned:
            continue
        indent = len(ln) - len(ln.lstrip(" :+-"))
        for sub in lines[i + 1:]:
            sub_indent = len(sub) - len(sub.lstrip(" :+-"))
            if sub_indent <= indent:
                break
            body = sub.lstrip(" :+-")
            if body.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate", "TakeOrderedAndProject")):
                break  # a rollup, or the k rows of a top-k
            if "Scan " in body or body.startswith("FileScan"):
                bad.append(stripped[:80])
                break
    return bad


def test_no_unpartitioned_window_over_raw_rows(plans):
    offenders = {k: w for k, t in plans.items() if (w := _unpartitioned_windows_over_raw_rows(t))}
    assert offenders == {}


def test_window_detector_is_not_vacuous(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window
    raw = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    bad = raw.withColumn("rn", F.row_number().over(Window.orderBy("o_orderdate")))
    assert _unpartitioned_windows_over_raw_rows(plan_text(bad, "simple"))
    ok = raw.groupBy("o_orderdate").count().withColumn("rn", F.row_number().over(Window.orderBy("o_orderdate")))
    assert not _unpartitioned_windows_over_raw_rows(plan_text(ok, "simple"))


def test_broadcast_hints_only_behind_a_size_check():
    """``F.broadcast`` is used only inside ``session.broadcast_below`` (for a
    size in bytes known beforehand); everything else is left to the planner.
    The optional training-data folder hints only samples cut by a limit."""
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "chronoframe"
    offenders = [str(p) for p in root.rglob("*.py") if p.name != "session.py" and "llm" not in p.parts
                 and "F.broadcast(" in p.read_text()]
    assert offenders == []
