"""Join operators.

Both sides are pre-aggregated before outer joins (Catalyst does not push an
aggregate below a full outer join). No side is hinted: the planner and
AQE broadcast what their sizes allow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col, last_of_key
from chronoframe.operators.keyfilter import possible_keys


def _keys(k) -> list:
    return [k] if isinstance(k, str) else list(k)


# J01
def full_outer_daily(a: DataFrame, b: DataFrame, date: str, fill=0) -> DataFrame:
    """Two daily rollups full-outer on date; absent measures → ``fill``.
    Joining with ``USING`` coalesces the key; NULL dates never match, so two
    NULL-date rows both survive."""
    joined = a.join(b, on=date, how="full_outer")
    measures = [c for c in joined.columns if c != date]
    return joined.fillna(fill, subset=measures) if fill is not None else joined


# J02
def full_outer_3way(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Three rollups on one key; the third matches ``coalesce(a.k, b.k)``
    (the USING form does that); missing measures stay NULL."""
    return a.join(b, on=key, how="full_outer").join(c, on=key, how="full_outer")


# J03
def date_merge_fill(frames: Mapping[str, DataFrame], date: str, value: str) -> DataFrame:
    """N-way outer merge of daily series by date, absent = 0, as one union +
    pivot (one shuffle) instead of N−1 full outer joins."""
    names = list(frames)
    long = None
    for n, df in frames.items():
        part = df.select(as_col(date).alias(date), F.lit(n).alias("__series"), as_col(value).alias("__v"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(date).pivot("__series", names).agg(F.sum("__v"))
    return wide.fillna(0, subset=names)


def date_merge_rollup(rollup: DataFrame, date: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """``date_merge_fill`` for series that one (date, series) rollup holds:
    the rollup itself is pivoted, so its source is read once."""
    some = rollup.filter(F.col(series).isin(list(names)))
    wide = some.groupBy(date).pivot(series, list(names)).agg(F.sum(value))
    return wide.fillna(0, subset=list(names))


# J04
def inverse_pair_join(pairs: DataFrame, src: str, dst: str, measures: Sequence[str],
                      left_suffix: str = "_ab", right_suffix: str = "_ba",
                      left_fmt: str | None = None, right_fmt: str | None = None) -> DataFrame:
    """Pair stats next to the reverse direction (``a.src = b.dst AND a.dst =
    b.src``, keeping ``a.src < a.dst``); pairs lacking the reverse direction
    drop out. ``pairs`` holds one row per directed pair (``pair_stats``).

    Expressed without the self-join: each row is keyed by its unordered pair
    (least, greatest) and one aggregation puts the forward and reverse
    measures side by side. Output names are ``{m}{suffix}`` or, with
    ``left_fmt``/``right_fmt``, a pattern such as ``"a_to_b_{m}"``. The (possibly expensive) input is computed once and
    shuffled once, where a self-join would evaluate it twice."""
    a, b = as_col(src), as_col(dst)
    lo, hi = F.least(a, b), F.greatest(a, b)
    fwd = a < b
    valid = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b))
    aggs = [F.count_if(fwd).alias("__nf"), F.count_if(~fwd).alias("__nb")]
    lname = (lambda m: left_fmt.format(m=m)) if left_fmt else (lambda m: f"{m}{left_suffix}")
    rname = (lambda m: right_fmt.format(m=m)) if right_fmt else (lambda m: f"{m}{right_suffix}")
    aggs += [F.max(F.when(fwd, as_col(m))).alias(lname(m)) for m in measures]
    aggs += [F.max(F.when(~fwd, as_col(m))).alias(rname(m)) for m in measures]
    g = valid.groupBy(lo.alias(src), hi.alias(dst)).agg(*aggs)
    return g.filter((F.col("__nf") > 0) & (F.col("__nb") > 0)).drop("__nf", "__nb")


# J05
def left_enrich(a: DataFrame, b: DataFrame, key, fill: Mapping[str, object],
                subtract: Mapping[str, tuple] | None = None) -> DataFrame:
    """Left merge, fill the unmatched measures, then ``out = total − part``."""
    res = a.join(b, on=_keys(key), how="left").fillna(dict(fill))
    for out, (total, part) in (subtract or {}).items():
        res = res.withColumn(out, as_col(total) - as_col(part))
    return res


# J06
def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], value: str, lookup_value: str,
                out: str = "ratio", scale: float = 1e6 * 100, order=None) -> DataFrame:
    """Keyed lookup; of several lookup rows per key the last by ``order`` (a
    column or expression) counts, even when its value is NULL; without an
    order, several rows for a key are an error. A missing or zero lookup value
    gives NULL; ratio = value × scale / lookup."""
    lk = lookup.groupBy(*keys).agg(last_of_key(lookup_value, order).alias("__lv"))
    res = df.join(lk, on=list(keys), how="left")  # aggregated side: AQE broadcasts it when small
    ratio = F.try_divide(as_col(value).cast("double") * F.lit(scale), F.nullif(F.col("__lv").cast("double"), F.lit(0.0)))
    return res.withColumn(out, ratio).withColumnRenamed("__lv", lookup_value)


# J07
def anti_existing(batch: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``target``. A filter of the
    batch's keys meets the target at its scan, so only keys that may be in
    the batch are shuffled, however large the target is."""
    k = _keys(keys)
    return batch.join(possible_keys(target, batch, k), on=k, how="left_anti")


# J08
def near_events(points: DataFrame, events: DataFrame, date_a: str, date_b: str, days: int = 3) -> DataFrame:
    """Pairs with ``|a − b| < days`` (strict), as a range join: both sides are
    binned by ``days``; each point probes its own and the neighbouring bins
    through an equi-join, and a residual filter keeps the exact condition."""
    w = int(days)
    pa = points.withColumn("__ua", F.unix_date(as_col(date_a)))
    pa = pa.withColumn("__bin", F.explode(F.array(*[(F.floor(F.col("__ua") / w) + o).cast("long") for o in (-1, 0, 1)])))
    eb = events.withColumn("__ub", F.unix_date(as_col(date_b))).withColumn("__bin", F.floor(F.col("__ub") / w).cast("long"))
    # A small point side (e.g. a calendar) becomes a broadcast join under AQE,
    # so a day holding a third of all events never lands in one task; a large
    # one stays a shuffle join whose skewed bins AQE splits.
    j = pa.join(eb, "__bin", "inner").filter(F.abs(F.col("__ua") - F.col("__ub")) < w)
    return j.drop("__bin", "__ua", "__ub")


# J09
def semi_selected(df: DataFrame, selected: DataFrame, key: str, selected_key: str | None = None) -> DataFrame:
    """Rows whose key is in the selected set; an empty set selects nothing."""
    sk = selected_key or key
    sel = selected.select(as_col(sk).alias("__k")).distinct()
    return df.join(sel, as_col(key) == F.col("__k"), "left_semi")  # AQE broadcasts a small selection


# J10
def coverage_table(frames: Mapping[str, tuple]) -> DataFrame:
    """Per dataset (name, start, end, count), one aggregate each, unioned;
    an empty dataset shows 'N/A' dates and 0."""
    out = None
    for name, (df, date) in frames.items():
        row = df.agg(F.min(F.to_date(as_col(date))).alias("__s"), F.max(F.to_date(as_col(date))).alias("__e"),
                     F.count(F.lit(1)).alias("count"))
        row = row.select(F.lit(name).alias("dataset"),
                         F.coalesce(F.col("__s").cast("string"), F.lit("N/A")).alias("start_date"),
                         F.coalesce(F.col("__e").cast("string"), F.lit("N/A")).alias("end_date"), "count")
        out = row if out is None else out.unionByName(row)
    return out
