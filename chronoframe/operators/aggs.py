"""Aggregation operators.

Grouped work is ``groupBy().agg()`` — partial aggregation before the shuffle,
so a key holding a third of all rows costs one partial row per input
partition, not a hot reducer. Global scalars are scalar subqueries
(``DataFrame.scalar()``), evaluated once and shipped as a literal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe import functions as fx
from chronoframe.functions.common import as_col


def _keys(keys) -> list:
    if keys is None:
        return []
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def _grouped(df: DataFrame, keys):
    k = _keys(keys)
    return df.groupBy(*k) if k else df.groupBy()


# A01
def table_stats(df: DataFrame, date: str, prefix: str = "") -> DataFrame:
    """count, min date, max date in one pass."""
    return df.agg(F.count(F.lit(1)).alias(f"{prefix}count"),
                  F.min(date).alias(f"{prefix}min_date"),
                  F.max(date).alias(f"{prefix}max_date"))


# A02
def table_count(df: DataFrame, out: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


# A03
def global_sums(df: DataFrame, date: str, measures: Mapping[str, str], days: str = "days") -> DataFrame:
    """``count(distinct date)`` and ``coalesce(sum(x), 0)``; empty input gives 0."""
    aggs = [F.count_distinct(date).alias(days)]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(o) for o, c in measures.items()]
    return df.agg(*aggs)


# A04
def max_of_cumulative(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Latest total of a monotone counter = MAX(col); missing → 0."""
    return df.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(o) for o, c in cols.items()])


# A05
def group_count_sum(df: DataFrame, keys, measure: str | None = None, date: str | None = None,
                    count: str = "count", total: str = "total", drop_null_keys: bool = False) -> DataFrame:
    """Group by 1–2 categories → count and coalesced sum (and first/last date).
    SQL semantics keep a NULL group; ``drop_null_keys`` gives the pandas one."""
    k = _keys(keys)
    src = df
    if drop_null_keys:
        for c in k:
            src = src.filter(as_col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias(count)]
    if measure is not None:
        aggs.append(F.coalesce(F.sum(measure), F.lit(0)).alias(total))
    if date is not None:
        aggs += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    return src.groupBy(*k).agg(*aggs)


# A06
def bucket_count(df: DataFrame, date: str, grain: str = "day", dims: Sequence[str] = (), aggs: Mapping[str, Column] | None = None,
                 out: str | None = None, count: str | None = "count", drop_null_dates: bool = True) -> DataFrame:
    """Group by a calendar bucket (day / Monday week / month / year) plus
    optional categories → count and any extra aggregates."""
    out = out or grain
    src = df.withColumn(out, fx.bucket(date, grain))
    if drop_null_dates:
        src = src.filter(F.col(out).isNotNull())
    exprs = [F.count(F.lit(1)).alias(count)] if count else []
    exprs += [e.alias(n) for n, e in (aggs or {}).items()]
    return src.groupBy(out, *dims).agg(*exprs)


# A07
def conditional_sums(df: DataFrame, keys, spec: Mapping[str, tuple], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``SUM(CASE WHEN cond THEN x ELSE 0 END)`` per output; ``x`` may be 1.
    ``extra`` adds further aggregates (e.g. a distinct count) to the same
    single aggregation."""
    exprs = [F.sum(F.when(cond, as_col(x) if isinstance(x, str) else F.lit(x) if not isinstance(x, Column) else x)
                   .otherwise(F.lit(0))).alias(o) for o, (cond, x) in spec.items()]
    exprs += [e.alias(n) for n, e in (extra or {}).items()]
    return _grouped(df, keys).agg(*exprs)


# A08
def conditional_avg(df: DataFrame, keys, spec: Mapping[str, tuple]) -> DataFrame:
    """``COALESCE(AVG(CASE WHEN cond THEN x END), 0)`` — no ELSE, NULLs skipped."""
    exprs = [F.coalesce(fx.mean(F.when(cond, as_col(x))), F.lit(0.0)).alias(o) for o, (cond, x) in spec.items()]
    return _grouped(df, keys).agg(*exprs)


# A09
def avg_or_zero(df: DataFrame, keys, col: str, out: str = "avg") -> DataFrame:
    return _grouped(df, keys).agg(F.coalesce(fx.mean(col), F.lit(0.0)).alias(out))


# A10
def count_distinct_group(df: DataFrame, keys, col: str, out: str = "distinct_count", approx: bool = False) -> DataFrame:
    """Exact distinct count per group (expand-by-(key, value) plan: a hot key's
    values spread over the shuffle). ``approx`` opts into HLL++."""
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return _grouped(df, keys).agg(agg.alias(out))


# A11
def having(agg_df: DataFrame, predicate) -> DataFrame:
    return agg_df.filter(predicate if isinstance(predicate, Column) else F.expr(predicate))


# A12
def guarded_ratio(num, den, digits: int | None = 1, else_=0.0, pct: bool = True) -> Column:
    """``round(num / den * 100, digits)`` when ``den > 0`` else ``else_``
    (no division by zero under ANSI, no infinities)."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    r = n / d * (100.0 if pct else 1.0)
    if digits is not None:
        r = F.round(r, digits)
    return F.when(d > 0, r).otherwise(F.lit(else_))


# A13
def pair_stats(df: DataFrame, a: str, b: str, measure: str | None = None, count: str = "n", avg: str = "avg") -> DataFrame:
    """Per ordered pair (blank and self pairs excluded): count, average."""
    src = df.filter(fx.not_blank(a) & fx.not_blank(b) & (as_col(a) != as_col(b)))
    exprs = [F.count(F.lit(1)).alias(count)]
    if measure:
        exprs.append(fx.mean(measure).alias(avg))
    return src.groupBy(a, b).agg(*exprs)


# A14
def pair_asymmetry(joined: DataFrame, avg_ab: str, avg_ba: str, n_ab: str, n_ba: str,
                   out_avg: str = "avg_asymmetry", out_n: str = "volume_asymmetry") -> DataFrame:
    return joined.withColumn(out_avg, F.abs(as_col(avg_ab) - as_col(avg_ba))) \
        .withColumn(out_n, F.abs(as_col(n_ab) - as_col(n_ba)))


# A15
def bidirectional_counts(df: DataFrame, a: str, b: str, focal: str, measure: str, k: int = 25,
                         out: str = "country", names: Sequence[str] = ("out_count", "in_count", "avg_out", "avg_in")
                         ) -> DataFrame:
    """Per counterparty of ``focal``: out/in counts and out/in averages, top k
    by total (ties by name). ``names`` renames the four measures."""
    from chronoframe.operators.clean import counterparty
    n_out, n_in, a_out, a_in = names
    cp = counterparty(df, a, b, focal, out=out, direction="__dir")
    is_out, is_in = F.col("__dir") == "out", F.col("__dir") == "in"
    res = cp.groupBy(out).agg(
        F.sum(F.when(is_out, 1).otherwise(0)).alias(n_out),
        F.sum(F.when(is_in, 1).otherwise(0)).alias(n_in),
        F.coalesce(fx.mean(F.when(is_out, as_col(measure))), F.lit(0.0)).alias(a_out),
        F.coalesce(fx.mean(F.when(is_in, as_col(measure))), F.lit(0.0)).alias(a_in),
    )
    return res.orderBy((F.col(n_out) + F.col(n_in)).desc(), F.col(out).asc()).limit(k)


# A16
def directional_weekly(df: DataFrame, date: str, a: str, b: str, focal: str, measure: str,
                       prefix_col: str, prefix: str) -> DataFrame:
    """Week × direction → count, average, prefix-conditional count."""
    from chronoframe.operators.clean import direction_class
    d = direction_class(df, a, b, focal)
    return bucket_count(d, date, "week", ["direction"], {
        "avg": F.coalesce(fx.mean(measure), F.lit(0.0)),
        "prefixed": F.sum(F.when(as_col(prefix_col).startswith(prefix), 1).otherwise(0)),
    })


# A17
def rounded_histogram(df: DataFrame, col: str, digits: int = 0, out: str = "bin", count: str = "count") -> DataFrame:
    """Group by ``round(x, digits)`` (half away from zero, on an exact decimal)."""
    b = F.round(as_col(col).cast("decimal(38,6)"), digits).cast("double")
    return df.filter(as_col(col).isNotNull()).groupBy(b.alias(out)).agg(F.count(F.lit(1)).alias(count))


# A18
def explode_count(df: DataFrame, array_col, date: str | None = None, out: str = "item", count: str = "count",
                  grain: str = "month") -> DataFrame:
    """Unnest an array and count items (NULL arrays drop out, multiplicity
    kept), overall or per calendar bucket."""
    cols = [F.explode(as_col(array_col)).alias(out)]
    if date:
        cols.append(fx.bucket(date, grain).alias(grain))
    ex = df.select(*cols)
    keys = [out] + ([grain] if date else [])
    return ex.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


# A19
def flags_to_counts(df: DataFrame, flags: Mapping[str, str], date: str | None = None, grain: str = "month",
                    out: str = "label", count: str = "count") -> DataFrame:
    """Wide 0/1 flag columns → (label, count of 1s).

    Totals come from one aggregate (so a label with no hits shows 0); the
    per-bucket form unpivots in the same scan and keeps only hits (a label
    with no hits in a bucket is absent)."""
    if date is None:
        wide = df.agg(*[F.count_if(as_col(c) == 1).alias(f"__f{i}") for i, c in enumerate(flags)])
        stack = ", ".join(f"'{lab}', `__f{i}`" for i, lab in enumerate(flags.values()))
        return wide.selectExpr(f"stack({len(flags)}, {stack}) as (`{out}`, `{count}`)")
    stack = ", ".join(f"'{lab}', `{c}`" for c, lab in flags.items())
    long = df.select(fx.bucket(date, grain).alias(grain), *flags.keys()) \
        .selectExpr(grain, f"stack({len(flags)}, {stack}) as (`{out}`, __v)")
    return long.filter((F.col("__v") == 1) & F.col(grain).isNotNull()).groupBy(grain, out) \
        .agg(F.count(F.lit(1)).alias(count))


# A20
def superset_member(df: DataFrame, member: str, members, name: str, dims: Sequence[str],
                    sums: Sequence[str], null_cols: Sequence[str] = ()) -> DataFrame:
    """Append synthetic member rows (``name``) = sums over the member set by
    the remaining dims; columns where a sum is meaningless stay NULL.

    One pass over ``df`` (a rollup: one row per member and dims): each row of
    a member is emitted under its own name and under ``name`` (``explode``),
    and one aggregation by (dims, member) reproduces the original rows and
    builds the synthetic ones. ``members`` is a list (literal ``isin``) or a
    one-column DataFrame (left join; the planner broadcasts it below its size threshold)."""
    if isinstance(members, DataFrame):
        m = members.select(F.col(members.columns[0]).alias("__m")).distinct().withColumn("__in", F.lit(True))
        flagged = df.join(m, as_col(member) == F.col("__m"), "left") \
            .withColumn("__in", F.coalesce("__in", F.lit(False))).drop("__m")
    else:
        flagged = df.withColumn("__in", as_col(member).isin(list(members)))
    tags = F.when(F.col("__in"), F.array(as_col(member), F.lit(name))).otherwise(F.array(as_col(member)))
    tagged = flagged.withColumn("__tags", tags).drop(member).withColumn(member, F.explode("__tags")).drop("__tags", "__in")
    synthetic = F.col(member) == name
    others = [c for c in df.columns if c not in set(dims) | {member} | set(sums)]
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.when(synthetic & F.lit(c in set(null_cols)), F.lit(None)).otherwise(F.max(c)).cast(dict(df.dtypes)[c]).alias(c)
             for c in others]
    return tagged.groupBy(*dims, member).agg(*aggs).select(*df.columns)


# A21
def value_fallback_sum(df: DataFrame, keys, text_col: str, out: str = "total") -> DataFrame:
    """Exact sum of plain decimal text (other text counts as 0) and the row count
    of each group. ``out`` is canonical decimal text of any length; cast it to
    double for the nearest double. Limbs of nine digits are summed, those that
    nearly all numbers have as columns of one hash aggregate, further ones as
    rows of their own; carries move once on the sums of a group."""
    keyed = df.select(*_keys(keys), fx.exact_number(text_col).alias("__x"))
    names = [f"`{c}`" for c in keyed.columns[:-1]]
    inner = F.struct(F.lit(None).cast("int").alias("i"), *[fx.limb("__x", i).cast(fx.exact.SUM).alias(f"l{k}")
                                                           for k, i in enumerate(fx.exact.INNER)])
    zero = F.lit(0).cast(fx.exact.SUM)
    more = F.transform(fx.outer_limbs("__x"), lambda e: F.struct(
        e["i"].alias("i"), e["s"].alias("l0"), *[zero.alias(f"l{k}") for k in range(1, len(fx.exact.INNER))]))
    sums = (keyed.select(*names, F.explode(F.concat(F.array(inner), more)).alias("e")).groupBy(*names, F.col("e.i").alias("__i"))
            .agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"e.l{k}").cast(fx.exact.SUM).alias(f"__l{k}")
                                                   for k in range(len(fx.exact.INNER))]))
    entries = F.when(F.col("__i").isNull(), F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"__l{k}").alias("s")) for k, i in enumerate(fx.exact.INNER)])
    ).otherwise(F.array(F.struct(F.col("__i").alias("i"), F.col("__l0").alias("s"))))
    total = (sums.groupBy(*names) if names else sums.groupBy()).agg(
        F.flatten(F.collect_list(entries)).alias("__e"), F.sum(F.when(F.col("__i").isNull(), F.col("__n"))).alias("count"))
    return total.select(*names, fx.carried("__e").alias(out), F.coalesce("count", F.lit(0)).alias("count"))


# A22
def reaggregate_selected(df: DataFrame, selections: Mapping[str, Sequence], keys, sums: Sequence[str],
                         trim: Sequence[str] = ()) -> DataFrame:
    """Filter by several selected sets (empty set → nothing), trim keys, re-sum."""
    src = df.withColumns({c: F.trim(as_col(c)) for c in trim}) if trim else df
    for c, vals in selections.items():
        vals = list(vals)
        src = src.filter(as_col(c).isin(vals)) if vals else src.filter(F.lit(False))
    return _grouped(src, keys).agg(*[F.sum(s).alias(s) for s in sums])


# A23
def reaggregate_coarser(rollup: DataFrame, keys, sums: Sequence[str], grain: str | None = None, date: str | None = None) -> DataFrame:
    """Roll a finer rollup up: to a coarser calendar grain or to fewer keys."""
    src = rollup
    k = _keys(keys)
    if grain:
        src = src.withColumn(grain, fx.bucket(date, grain))
        k = [grain] + k
    return src.groupBy(*k).agg(*[F.sum(s).alias(s) for s in sums])


# A24
def share_of_total(rollup: DataFrame, value: str, out: str = "pct", digits: int | None = 1) -> DataFrame:
    """value / grand total × 100; the total is a scalar subquery."""
    total = rollup.select(F.sum(value)).scalar()
    r = as_col(value).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100.0
    return rollup.withColumn(out, F.round(r, digits) if digits is not None else r)


# A25
def latest_row(df: DataFrame, order: str, keys=(), cols: Sequence[str] | None = None) -> DataFrame:
    """Last row by ``order`` per key: ``max_by`` over a struct. Spark runs it
    as a sort aggregate, partial before the shuffle, so at most one row per
    key and input partition is moved and a repeated key is reduced first."""
    k = _keys(keys)
    cols = [c for c in (cols or df.columns) if c not in k]
    picked = _grouped(df, k).agg(F.max_by(F.struct(*cols), as_col(order)).alias("__r"))
    return picked.select(*k, "__r.*")


# A26
def peak_abs(df: DataFrame, value: str, order: str, keys=()) -> DataFrame:
    """Row of maximum |value|; ties keep the earliest ``order``."""
    k = _keys(keys)
    others = [c for c in df.columns if c not in k]
    best = _grouped(df, k).agg(F.min(F.struct((-F.abs(as_col(value))).alias("__k"), as_col(order).alias("__o"),
                                              F.struct(*others).alias("__row"))).alias("__b"))
    return best.select(*k, "__b.__row.*")


# A27
def period_summary(df: DataFrame, value: str, keys=()) -> DataFrame:
    v = as_col(value)
    return _grouped(df, keys).agg(
        F.sum(v).alias("total_change"), F.max(v).alias("max_gain"), F.min(v).alias("max_loss"),
        F.count_if(v > 0).alias("positive_periods"), F.count_if(v < 0).alias("negative_periods"),
        fx.mean(v).alias("mean_change"))


# A28
def range_summary(df: DataFrame, date: str, value: str, lo=None, hi=None, keys=()) -> DataFrame:
    """current = last value, net = last − first, monthly = net / rows × 30;
    an empty range gives zeros."""
    src = df
    if lo is not None:
        src = src.filter(as_col(date) >= F.lit(lo).cast("date"))
    if hi is not None:
        src = src.filter(as_col(date) <= F.lit(hi).cast("date"))
    agg = _grouped(src, keys).agg(F.max_by(value, date).alias("__last"), F.min_by(value, date).alias("__first"),
                                  F.count(F.lit(1)).alias("__n"))
    net = F.col("__last") - F.col("__first")
    return agg.select(*_keys(keys),
                      F.coalesce(F.col("__last"), F.lit(0.0)).alias("current"),
                      F.coalesce(net, F.lit(0.0)).alias("net_change"),
                      F.coalesce(net / F.nullif(F.col("__n"), F.lit(0)) * 30.0, F.lit(0.0)).alias("monthly_avg"))


def _pearson_expr(x: Column, y: Column) -> Column:
    n = F.count(F.lit(1)).cast("double")
    sx, sy = F.sum(x), F.sum(y)
    sxy, sx2, sy2 = F.sum(x * y), F.sum(x * x), F.sum(y * y)
    num = n * sxy - sx * sy
    den = F.sqrt((n * sx2 - sx * sx) * (n * sy2 - sy * sy))
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


# A29
def pearson(df: DataFrame, x: str, y: str, keys=(), out: str = "r") -> DataFrame:
    """Sum-form Pearson r; n = 0 or zero variance → 0 (built-in ``corr``
    raises on zero variance under ANSI)."""
    return _grouped(df, keys).agg(_pearson_expr(as_col(x).cast("double"), as_col(y).cast("double")).alias(out))


# A30
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise r in one aggregate, then stacked long: (a, b, r); the
    diagonal is 1 and the matrix symmetric."""
    exprs, entries = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j <= i:
                continue
            exprs.append(_pearson_expr(as_col(a).cast("double"), as_col(b).cast("double")).alias(f"__r{i}_{j}"))
    wide = df.agg(*exprs) if exprs else df.agg(F.count(F.lit(1)).alias("__n"))
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            val = "cast(1.0 as double)" if i == j else f"`__r{min(i, j)}_{max(i, j)}`"
            entries.append(f"'{a}', '{b}', {val}")
    return wide.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) as (a, b, r)")


def correlation_matrix_long(df: DataFrame, series: str, date: str, value: str, dates_at_once: int = 256,
                            series_at_once: int = 256) -> DataFrame:
    """The matrix of A30 for any number of series in long form: ``(a, b, r)`` of
    every ordered pair, diagonal 1, zero variance → 0. Dates that a series
    lacks count as 0, rows of one cell add up, NULL values count as 0, rows
    without a series are left out.

    A blocked Gram matrix: each group of dates gives the outer product of
    every pair of series blocks, and the products of a pair of blocks are
    summed in one task of ``series_at_once`` squared numbers. The driver holds
    the names of the series only, a root of the result.
    """
    src = df.filter(F.col(series).isNotNull()).select(F.col(series).cast("string").alias("s"), F.col(date).cast("string").alias("d"),
                                                      F.col(value).cast("double").alias("v"))
    names = [r[0] for r in src.select("s").distinct().orderBy("s").collect()]
    n = src.select("d").distinct().count()
    groups = max(1, -(-n // dates_at_once))
    size, width = len(names), series_at_once
    number = {s: i for i, s in enumerate(names)}
    part = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("xy", pa.binary()), ("x", pa.binary()), ("xx", pa.binary())])

    def products(table: pa.Table) -> pa.Table:
        days = table.column("d").combine_chunks().dictionary_encode(null_encoding="encode")
        col = table.column("s").combine_chunks().dictionary_encode()
        at = np.array([number[s] for s in col.dictionary.to_pylist()], np.int64)[col.indices.to_numpy()]
        x = np.zeros((len(days.dictionary), size))
        np.add.at(x, (days.indices.to_numpy(), at), np.nan_to_num(table.column("v").to_numpy(zero_copy_only=False)))
        sums, squares = x.sum(0), (x * x).sum(0)
        rows: list[list] = [[], [], [], [], []]
        for bi in range(0, size, width):
            for bj in range(bi, size, width):
                i, j = slice(bi, bi + width), slice(bj, bj + width)
                for out, v in zip(rows, (bi, bj, (x[:, i].T @ x[:, j]).tobytes(),
                                         np.concatenate([sums[i], sums[j]]).tobytes(),
                                         np.concatenate([squares[i], squares[j]]).tobytes()), strict=True):
                    out.append(v)
        return pa.table([pa.array(v, f.type) for v, f in zip(rows, part, strict=True)], schema=part)

    def correlations(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        ni, nj = min(width, size - bi), min(width, size - bj)
        xy, x, xx = (np.sum([np.frombuffer(b.as_buffer()) for b in table.column(c)], axis=0) for c in ("xy", "x", "xx"))
        cov = n * xy.reshape(ni, nj) - np.outer(x[:ni], x[ni:])
        var = n * xx - x * x
        scale = np.sqrt(np.outer(var[:ni], var[ni:]))
        r = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)
        if bi == bj:
            np.fill_diagonal(r, 1.0)
        i, j = np.divmod(np.arange(ni * nj), nj)
        known = pa.array(names)
        a, b = known.take(pa.array(bi + i)), known.take(pa.array(bj + j))
        one = pa.table({"a": a, "b": b, "r": pa.array(r.ravel())})
        return one if bi == bj else pa.concat_tables([one, pa.table({"a": b, "b": a, "r": one.column("r")})])

    partial = (src.withColumn("g", F.pmod(F.xxhash64("d"), F.lit(groups))).groupBy("g")
               .applyInArrow(products, "bi int, bj int, xy binary, x binary, xx binary"))
    return partial.groupBy("bi", "bj").applyInArrow(correlations, "a string, b string, r double")


# A31
def linear_trend(df: DataFrame, order: str, value: str, series=(), fitted: str = "trend") -> DataFrame:
    """OLS of value on the 0-based row index per series, in the sum form
    ``slope = (nΣxy − ΣxΣy) / (nΣx² − (Σx)²)``, ``intercept = (Σy − slope·Σx) / n``,
    plus the fitted value on every row; fewer than 2 rows → slope 0 and
    intercept = first value. Meant for rollups (one row per series and date):
    the index is a row_number partitioned by series."""
    k = _keys(series)
    w = Window.partitionBy(*k).orderBy(order) if k else Window.orderBy(order)
    idx = df.withColumn("__i", (F.row_number().over(w) - 1).cast("double"))
    y = as_col(value).cast("double")
    x = F.col("__i")
    fit = idx.groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(x).alias("__sx"), F.sum(y).alias("__sy"),
                              F.sum(x * y).alias("__sxy"), F.sum(x * x).alias("__sxx"), F.min_by(y, x).alias("__v0"))
    n, sx, sy, sxy, sxx = (F.col(c) for c in ("__n", "__sx", "__sy", "__sxy", "__sxx"))
    slope = F.when(n < 2, F.lit(0.0)).otherwise((n * sxy - sx * sy) / (n * sxx - sx * sx))
    fit = fit.withColumn("slope", slope)
    fit = fit.withColumn("intercept", F.when(n < 2, F.coalesce(F.col("__v0"), F.lit(0.0)))
                         .otherwise((sy - F.col("slope") * sx) / n))
    fit = fit.select(*k, "slope", "intercept")
    if k:
        joined = idx.join(fit, k, "inner")
    else:  # a single fit: two scalar subqueries (merged into one by the optimizer), no join
        joined = idx.withColumns({"slope": fit.select("slope").scalar(), "intercept": fit.select("intercept").scalar()})
    return joined.withColumn(fitted, F.col("intercept") + F.col("slope") * F.col("__i")).drop("__i")


# A32
def split_daily(df: DataFrame, date: str, pattern_col: str, pattern: str, launched: str, destroyed: str,
                count_col: str) -> DataFrame:
    """Daily totals, non-null count, the pattern-matching part and the rest,
    all in one pass (NULL / unparseable dates dropped)."""
    hit = fx.icontains(pattern_col, pattern)
    src = df.filter(as_col(date).isNotNull())
    res = src.groupBy(date).agg(
        F.sum(launched).alias("total_launched"), F.sum(destroyed).alias("total_destroyed"),
        F.count(count_col).alias("attacks"),
        F.sum(F.when(hit, as_col(launched)).otherwise(F.lit(0))).alias("drones_launched"),
        F.sum(F.when(hit, as_col(destroyed)).otherwise(F.lit(0))).alias("drones_destroyed"))
    return res.withColumn("missiles_launched", F.col("total_launched") - F.col("drones_launched")) \
        .withColumn("missiles_destroyed", F.col("total_destroyed") - F.col("drones_destroyed"))


# A33
def by_category_rate(df: DataFrame, key: str, num: str, den: str, count_col: str | None = None,
                     digits: int = 1, min_total: float | None = None) -> DataFrame:
    """Per category sums, attack count, guarded rate; optional ``sum > x``."""
    res = df.groupBy(key).agg(F.coalesce(F.sum(den), F.lit(0)).alias("total_launched"),
                              F.coalesce(F.sum(num), F.lit(0)).alias("total_destroyed"),
                              F.count(count_col if count_col else F.lit(1)).alias("attacks"))
    res = res.withColumn("intercept_rate", guarded_ratio("total_destroyed", "total_launched", digits))
    if min_total is not None:
        res = res.filter(F.col("total_launched") > min_total)
    return res
