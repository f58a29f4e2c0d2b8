"""Projection, predicate and cleaning operators.

Every function maps a DataFrame to a DataFrame with Catalyst expressions
only, so they fuse into one whole-stage-codegen span and predicates on raw
columns reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe import functions as fx
from chronoframe.functions.common import as_col
from chronoframe.functions.dates import DOTTED_DMY, ISO_PREFIX


# P01
def project_alias(df: DataFrame, columns: Mapping[str, object]) -> DataFrame:
    """Select and rename: ``{new_name: column name or Column}``."""
    return df.select(*[as_col(v).alias(k) for k, v in columns.items()])


def _map_literal(mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


# P02
def case_label(df: DataFrame, code: str, labels: Mapping, default=None, out: str = "label") -> DataFrame:
    """Code → label with an ELSE branch (a literal map, no join)."""
    found = F.try_element_at(_map_literal(labels), as_col(code))
    fallback = F.lit(default) if not isinstance(default, Column) else default
    return df.withColumn(out, F.when(found.isNotNull(), found).otherwise(fallback))


# P03
def dict_label(df: DataFrame, code: str, dictionary: DataFrame, dict_code: str, dict_label_col: str,
               out: str = "label", fallback: str = "Code ") -> DataFrame:
    """Dictionary lookup with a fallback of ``fallback || code``.

    Of several labels of one code the least counts. The planner broadcasts the
    dictionary when its statistics are below the threshold.
    """
    d = dictionary.groupBy(F.col(dict_code).alias("__code")).agg(F.min(dict_label_col).alias("__label"))
    joined = df.join(d, as_col(code) == F.col("__code"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__label"), F.concat(F.lit(fallback), as_col(code).cast("string")))) \
        .drop("__code", "__label")


def _present(c: Column) -> Column:
    return c.isNotNull()


# P04
def direction_class(df: DataFrame, a: str, b: str, focal: str, out: str = "direction") -> DataFrame:
    """Ordered 4-way class: outbound (a = focal, b present), inbound (b = focal,
    a present), internal (both focal), other. ``''`` counts as present."""
    ca, cb = as_col(a), as_col(b)
    return df.withColumn(
        out,
        F.when((ca == focal) & (cb == focal), "internal")
        .when((ca == focal) & _present(cb), "outbound")
        .when((cb == focal) & _present(ca), "inbound")
        .otherwise("other"),
    )


# P05
def counterparty(df: DataFrame, a: str, b: str, focal: str, out: str = "country", direction: str = "direction") -> DataFrame:
    """For rows touching ``focal``: the other party and the direction; rows
    where the other party is NULL, blank or the focal party itself are dropped."""
    ca, cb = as_col(a), as_col(b)
    other = F.when(ca == focal, cb).when(cb == focal, ca)
    dirn = F.when(ca == focal, "out").when(cb == focal, "in")
    res = df.withColumn(out, other).withColumn(direction, dirn)
    return res.filter(fx.not_blank(out) & (F.col(out) != focal))


# P06
def filter_not_blank(df: DataFrame, cols: Sequence[str], sentinels: Iterable[str] = ()) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & fx.not_blank(c, tuple(sentinels))
    return df.filter(cond)


# P07
def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(as_col(col) == F.lit(value))


# P08
def filter_int_range(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Closed range on a raw integer column (prunes row groups by min/max)."""
    return df.filter(as_col(col).between(lo, hi))


# P09
def filter_in_set(df: DataFrame, col: str, values) -> DataFrame:
    """Set membership; an empty set selects nothing. A DataFrame of values is
    applied as a semi join (AQE broadcasts a small set)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("__v")).distinct()
        return df.join(v, as_col(col) == F.col("__v"), "left_semi")  # AQE broadcasts a small set
    values = list(values)
    if not values:
        return df.filter(F.lit(False))
    return df.filter(as_col(col).isin(values))


# P10
def filter_date_range(df: DataFrame, col: str, lo: str, hi: str, keep_unparseable: bool = False) -> DataFrame:
    """Closed ISO-date window. ``keep_unparseable`` is the lenient variant:
    rows whose value is not a parseable date string (NULL, garbage) are kept,
    and a numeric column (yearly data) is not filtered at all."""
    c = as_col(col)
    dtype = dict(df.dtypes).get(col, "")
    numeric = dtype in ("int", "bigint", "smallint", "tinyint", "double", "float") or dtype.startswith("decimal")
    if keep_unparseable and numeric:
        return df
    d = F.to_date(c) if dtype in ("date", "timestamp", "timestamp_ntz") else F.try_to_date(c.cast("string"))
    inside = d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    if keep_unparseable:
        return df.filter(d.isNull() | inside)
    return df.filter(inside)


# P11
def filter_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.filter(as_col(col).startswith(prefix))


# P12
def filter_icontains(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(fx.icontains(col, pattern))


# P13
def guarded_numeric(df: DataFrame, col: str, out: str | None = None, scale: int | None = None) -> DataFrame:
    """Plain decimal text → its value, any other text → 0. Exact canonical text of
    any length; with ``scale`` a DECIMAL(38, scale), NULL where digits would be lost."""
    return df.withColumn(out or col, fx.exact_number(col) if scale is None else fx.guarded_numeric(col, scale))


# The route tables of the reference's mixed date parsers
# (patterns from functions.dates; formats in the order they are tried).
DATE_ROUTES = {
    "dotted": [(DOTTED_DMY, "dd.MM.yyyy"), (ISO_PREFIX, None)],
    "dayname": ["d MMMM yyyy", "yyyy-MM-dd"],
    "slashed": ["dd/MM/yyyy", "yyyy-MM-dd"],
}


# P14
def parse_mixed_date(df: DataFrame, col: str, kind: str = "dotted", out: str = "parsed_date",
                     anchored_first: bool = False) -> DataFrame:
    """Route by pattern (``dotted``) or try formats in order (``dayname``,
    ``slashed``); anything else is NULL."""
    if kind == "dotted":
        expr = fx.parse_mixed_date(col, DATE_ROUTES["dotted"], anchored_first=anchored_first)
    elif kind == "mixed":
        expr = F.coalesce(fx.safe_date(col), fx.parse_first_format(col, DATE_ROUTES["slashed"][:1] + ["d MMMM yyyy"]))
    else:
        expr = fx.parse_first_format(col, DATE_ROUTES[kind])
    return df.withColumn(out, expr)


# P15
def int_date(df: DataFrame, col: str, kind: str = "to_date", out: str | None = None) -> DataFrame:
    """``to_int``: date → YYYYMMDD; ``to_date``: YYYYMMDD → date;
    ``ts14``: YYYYMMDDHHMMSS bigint → date."""
    f = {"to_int": fx.date_to_int, "to_date": fx.int_to_date, "ts14": fx.bigint_ts_to_date}[kind]
    return df.withColumn(out or col, f(col))


# P16
def safe_cast(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """``{column: kind}`` with kinds from ``functions.CASTERS``."""
    return df.withColumns({c: fx.CASTERS[k](c) for c, k in spec.items()})


# P17
def typed_projection(df: DataFrame, spec: Mapping[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """One projection applying a caster per declared column, in declared order;
    declared columns missing from the input are skipped."""
    cols = [c for c in (order or list(spec)) if c in df.columns]
    return df.select(*[fx.CASTERS[spec.get(c, "text")](c).alias(c) for c in cols])


# P18
def null_fill(df: DataFrame, values: Mapping[str, object], nan_as_null: Sequence[str] = ()) -> DataFrame:
    """NaN → NULL on the listed columns, then COALESCE the given defaults."""
    out = df.withColumns({c: fx.nan_to_null(c) for c in nan_as_null}) if nan_as_null else df
    return out.withColumns({c: F.coalesce(as_col(c), F.lit(v)) for c, v in values.items()})


# P19
def total_fallback(df: DataFrame, total: str, parts: Sequence[str], out: str | None = None) -> DataFrame:
    """``COALESCE(total, a + b, 0)`` on the raw columns: a NULL part makes the
    sum NULL, so the fallback is 0 then."""
    s = None
    for p in parts:
        s = as_col(p) if s is None else s + as_col(p)
    return df.withColumn(out or total, F.coalesce(as_col(total), s, F.lit(0)))


# P20
def tier_bucket(df: DataFrame, col: str, bounds: Sequence[float], labels: Sequence[str], out: str = "tier",
                absolute: bool = False) -> DataFrame:
    """``bounds`` descending: first label for ``x >= bounds[0]``, …, last label
    for the rest (``len(labels) == len(bounds) + 1``)."""
    c = F.abs(as_col(col)) if absolute else as_col(col)
    expr = None
    for b, lab in zip(bounds, labels):
        expr = F.when(c >= b, lab) if expr is None else expr.when(c >= b, lab)
    return df.withColumn(out, expr.otherwise(labels[-1]))


# P21
def clip(df: DataFrame, col: str, lo: float = -500, hi: float = 500, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, fx.clip(col, lo, hi))


# P22
def scale_units(df: DataFrame, col: str, factor: float, out: str | None = None, divide: bool = False) -> DataFrame:
    c = as_col(col)
    return df.withColumn(out or col, c / F.lit(factor) if divide else c * F.lit(factor))


# P23
def date_part_key(df: DataFrame, col: str, fmt: str = "yyyy-MM", out: str = "month", min_year: int | None = None) -> DataFrame:
    res = df.withColumn(out, F.date_format(as_col(col), fmt))
    if min_year is not None:
        res = res.filter(F.year(as_col(col)) >= min_year)
    return res


def year_month_key(df: DataFrame, year: str, month: str, out: str = "month", min_year: int = 2000) -> DataFrame:
    """Zero-padded ``Y-MM`` from year/month ints; rows with year < min_year or
    a NULL/0 year or month are dropped."""
    y, m = as_col(year), as_col(month)
    res = df.filter(y.isNotNull() & m.isNotNull() & (y != 0) & (m != 0) & (y >= min_year))
    return res.withColumn(out, F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))


# P24
def truncate_text(df: DataFrame, col: str, limit: int = 150, keep: int | None = None, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, fx.truncate_text(col, limit, keep))


# P25
def trim_key(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.trim(as_col(col)))


# P26
def name_crosswalk(df: DataFrame, col: str, mapping: DataFrame, src: str, dst: str, exclude: Iterable[str] = (),
                   out: str | None = None) -> DataFrame:
    """Map names through a crosswalk (identity when unmapped), then drop the
    excluded names. The crosswalk is data; of several targets of one name the
    least counts."""
    m = mapping.groupBy(F.col(src).alias("__src")).agg(F.min(dst).alias("__dst"))
    res = df.join(m, as_col(col) == F.col("__src"), "left") \
        .withColumn(out or col, F.coalesce(F.col("__dst"), as_col(col))).drop("__src", "__dst")
    ex = list(exclude)
    if ex:
        res = res.filter(~F.col(out or col).isin(ex))
    return res


def name_crosswalk_select(df: DataFrame, col: str, selection, mapping: DataFrame, src: str, dst: str,
                          exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    """Select rows of ``df`` (names in the target vocabulary in ``col``) by a
    selection made in the source vocabulary: drop excluded names, map the rest
    through the crosswalk (identity when unmapped), always add the reference
    members ``include`` (target vocabulary), then report ``col`` mapped back
    to the source vocabulary. ``selection`` is a list or a one-column
    DataFrame; the target rows are filtered by a semi join. Of several names
    that one name maps to, either way, the least counts."""
    spark = df.sparkSession
    sel = selection.select(F.col(selection.columns[0]).alias("__a")) if isinstance(selection, DataFrame) else \
        spark.createDataFrame([(v,) for v in selection], "__a string")
    ex = list(exclude)
    if ex:
        sel = sel.filter(~F.col("__a").isin(ex))
    fwd = mapping.groupBy(F.col(src).alias("__a")).agg(F.min(dst).alias("__b"))
    wanted = sel.join(fwd, "__a", "left").select(F.coalesce("__b", "__a").alias("__b"))
    inc = list(include)
    if inc:
        wanted = wanted.unionByName(spark.createDataFrame([(v,) for v in inc], "__b string"))
    picked = df.join(wanted.distinct(), as_col(col) == F.col("__b"), "left_semi")
    back = mapping.groupBy(F.col(dst).alias("__b")).agg(F.min(src).alias("__a"))
    out = picked.join(back, as_col(col) == F.col("__b"), "left")
    return out.withColumn(col, F.coalesce(F.col("__a"), as_col(col))).drop("__a", "__b")


# P27
def falsy_null(df: DataFrame, col: str, to: str = "null", out: str | None = None) -> DataFrame:
    """0 / NULL → NULL (``to='null'``, ratios) or → 0 (``to='zero'``, amounts)."""
    c = as_col(col)
    expr = F.nullif(c, F.lit(0)) if to == "null" else F.coalesce(c, F.lit(0))
    return df.withColumn(out or col, expr)


# P28
def round_decimals(df: DataFrame, col: str, digits: int = 2, mode: str = "half_up", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, fx.round_to(col, digits, mode))


# P29
def literal_tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))
