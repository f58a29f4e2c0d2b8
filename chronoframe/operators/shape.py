"""Reshaping (R01–R06), sorts and top-k (T01–T07), set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col


# R01
def pivot_sum(df: DataFrame, key, category: str, value: str, categories: Sequence) -> DataFrame:
    """One row per key, a column per (explicitly listed) category, absent = 0.
    Listing the values avoids the extra distinct job."""
    keys = [key] if isinstance(key, str) else list(key)
    cats = list(categories)
    wide = df.groupBy(*keys).pivot(category, cats).agg(F.sum(value))
    return wide.fillna(0, subset=[str(c) for c in cats])


# R02
def dense_grid(df: DataFrame, key: str, category: str, value: str, categories: Sequence[str] | None = None) -> DataFrame:
    """All keys × categories with 0 for gaps (long form): cells are summed,
    folded into one category → value map per key (bounded by the number of
    categories) and exploded over the category list — a literal array when
    given, else the category set from a distributed ``collect_set`` aggregate
    attached as a scalar subquery (safe for any number of keys)."""
    cells = df.groupBy(key, category).agg(F.sum(value).alias("__v"))
    per = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(category, "__v"))).alias("__m"))
    if categories is None:
        cats = cells.select(F.array_sort(F.collect_set(category))).scalar()
    else:
        cats = F.array(*[F.lit(c) for c in categories]).cast(f"array<{dict(df.dtypes)[category]}>")
    zero = F.lit(0).cast(dict(cells.dtypes)["__v"])
    grid = per.withColumn("__cats", cats).select(key, "__m", F.explode("__cats").alias(category))
    return grid.select(key, category, F.coalesce(F.element_at("__m", F.col(category)), zero).alias(value))


# R03
def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


# R04
def transpose_scores(df: DataFrame, name: str, metrics: Sequence[str], rank_by: str, k: int = 5) -> DataFrame:
    """Metrics as rows, the top-k entities (by ``rank_by``, ties by name) as
    columns ``name_1, value_1 .. name_k, value_k``: known before any job runs."""
    order = [F.col(rank_by).desc(), F.col(name).asc()]
    top = df.orderBy(*order).limit(k).withColumn("__rk", F.row_number().over(Window.orderBy(*order)))  # k rows
    long = top.unpivot([name, "__rk"], list(metrics), "metric", "__v")
    return long.groupBy("metric").agg(*[
        F.max(F.when(F.col("__rk") == i, F.col(c))).alias(f"{out}_{i}")
        for i in range(1, k + 1) for c, out in ((name, "name"), ("__v", "value"))])


# R05
def selected_total(df: DataFrame, groups: Mapping[str, Sequence[str]], enabled: Sequence[str], out: str = "total",
                   order: str | None = None) -> DataFrame:
    """Sum of the measure columns of the enabled groups; rows with total ≤ 0
    dropped; sorted by total descending."""
    cols = [c for g in enabled for c in groups[g]]
    total = None
    for c in cols:
        total = F.coalesce(as_col(c), F.lit(0)) if total is None else total + F.coalesce(as_col(c), F.lit(0))
    res = df.withColumn(out, total if total is not None else F.lit(0)).filter(F.col(out) > 0)
    return res.orderBy(F.col(out).desc(), *([F.col(order).asc()] if order else []))


# R06
def funding_gap(df: DataFrame, required: str, funded: str) -> DataFrame:
    """Rows with requirement > 0 → requirement, funded, gap, pct funded."""
    r, f = as_col(required).cast("double"), F.coalesce(as_col(funded).cast("double"), F.lit(0.0))
    return df.filter(r > 0).withColumn("gap", r - f).withColumn("pct_funded", f / r * 100.0)


# T01 / T02
def order_by(df: DataFrame, spec: Sequence[tuple]) -> DataFrame:
    """``[(col, 'asc'|'desc', 'first'|'last')]`` with NULL placement always
    explicit (engines disagree on the default)."""
    cols = []
    for col, direction, nulls in spec:
        c = as_col(col)
        cols.append(getattr(c, f"{direction}_nulls_{nulls}")())
    return df.orderBy(*cols)


# T03
def top_k(df: DataFrame, by: Sequence[tuple], k: int, tie: Sequence[str] = ()) -> DataFrame:
    """Order + limit (TakeOrderedAndProject: per-partition top-k, then merge);
    the tie-break keys make the cut deterministic."""
    spec = list(by) + [(t, "asc", "last") for t in tie]
    return order_by(df, spec).limit(k)


# T04
def order_by_expr(df: DataFrame, expr: Column, k: int | None = None, tie: Sequence[str] = (), desc: bool = True) -> DataFrame:
    e = expr.desc_nulls_last() if desc else expr.asc_nulls_last()
    res = df.orderBy(e, *[F.col(t).asc() for t in tie])
    return res.limit(k) if k else res


# T05
def top_k_resorted(df: DataFrame, by: str, k: int, name: str, collation: str | None = None) -> DataFrame:
    """Top k by measure (ties by name), then re-sorted alphabetically: by code
    point, or by a collation (``UNICODE`` is the locale order of a browser's
    default ``localeCompare``; code points break its ties)."""
    rank = _alphabetical(name, collation)
    return df.orderBy(F.col(by).desc(), *rank).limit(k).orderBy(*rank)


def _alphabetical(col: str, collation: str | None) -> list[Column]:
    return ([F.collate(as_col(col).cast("string"), collation).asc()] if collation else []) + [as_col(col).asc()]


# T06
def priority_sort(df: DataFrame, col: str, pinned: Sequence[str], out: str = "priority",
                  collation: str | None = None) -> DataFrame:
    """Pinned members first (in pinned order), then alphabetical (see ``top_k_resorted``)."""
    rank = F.lit(len(pinned))
    for i, p in enumerate(reversed(pinned)):
        rank = F.when(as_col(col) == p, F.lit(len(pinned) - 1 - i)).otherwise(rank)
    return df.withColumn(out, rank).orderBy(out, *_alphabetical(col, collation))


# T07
def top_groups_stacked(df: DataFrame, group: str, category: str, value: str, categories: Sequence, k: int = 20) -> DataFrame:
    """Groups ranked by their total across categories, top k, keeping the
    per-category columns."""
    wide = pivot_sum(df, group, category, value, categories)
    total = None
    for c in categories:
        total = F.col(str(c)) if total is None else total + F.col(str(c))
    return wide.withColumn("total", total).orderBy(F.col("total").desc(), F.col(group).asc()).limit(k)


# U01
def union_all_tagged(frames: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "source",
                     defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Union of several selects with a literal tag; columns a branch lacks get
    the default (0)."""
    defaults = defaults or {}
    out = None
    for name, df in frames.items():
        sel = [F.lit(name).alias(tag)] + [
            (as_col(c) if c in df.columns else F.lit(defaults.get(c, 0))).alias(c) for c in columns]
        part = df.select(*sel)
        out = part if out is None else out.unionByName(part)
    return out


# U02
def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


# U03
def distinct_values(df: DataFrame, cols: Sequence[str], collation: str | None = None) -> DataFrame:
    """Distinct combinations, sorted; text columns by ``collation`` if there is one (see ``top_k_resorted``)."""
    values = df.select(*cols).distinct()
    kinds = dict(values.dtypes)
    return values.orderBy(*[o for c in cols for o in _alphabetical(c, collation if kinds[c] == "string" else None)])


# U04
def overlay_by_key(frames: Sequence[DataFrame], key) -> DataFrame:
    """Keyed union where a later frame's record set replaces the earlier rows of
    the same key: all rows of the last frame that has the key stay, however
    many. NULL is a key like any other. Each frame is anti-joined with the
    distinct keys of the later ones; a hot key is split like any skewed join."""
    keys = [key] if isinstance(key, str) else list(key)
    out, later = frames[-1], None
    for i in range(len(frames) - 2, -1, -1):
        named = frames[i + 1].select(*[F.col(f"`{k}`").alias(f"__later{j}") for j, k in enumerate(keys)])
        later = (named if later is None else later.union(named)).distinct()
        same = F.lit(True)
        for j, k in enumerate(keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__later{j}"))
        out = frames[i].join(later, same, "left_anti").unionByName(out)
    return out
