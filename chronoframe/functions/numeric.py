"""Numeric cleaning and rounding helpers (all JVM-side expressions)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col
from chronoframe.functions.exact import exact_number

# Text the float caster treats as missing.
FLOAT_MISSING = ("", "nan", "NaN", "#N/A", "N/A", "None")


def guarded_numeric(c, scale: int = 18) -> Column:
    """Numeric value if the text matches ``^[0-9.]+$`` (and is a number), else 0.

    ``'1.2.3'`` passes the pattern but is no number, so it is 0; negatives and
    ``1e6`` are 0 too. The value is DECIMAL(38, scale), and NULL where that
    type would lose a digit; ``exact_number`` keeps every digit, as text.
    """
    exact = exact_number(c)
    decimals = F.length(exact) - F.length(F.substring_index(exact, ".", 1)) - 1  # -1 without a point
    return F.when(decimals <= scale, exact.try_cast(f"decimal(38,{scale})"))


def round_to(c, digits: int = 0, mode: str = "half_up") -> Column:
    """Round with one of three conventions.

    half_up   – away from zero on ties (SQL ``numeric`` ROUND)
    half_even – banker's rounding (pandas / Python ``round``)
    js        – ``floor(x * 10^n + 0.5) / 10^n`` (JavaScript ``Math.round``)
    """
    c = as_col(c)
    if mode == "half_up":
        return F.round(c, digits)
    if mode == "half_even":
        return F.bround(c, digits)
    if mode == "js":
        # decimal literals keep exact (decimal) input exact; doubles stay doubles
        p = F.lit(10 ** digits)
        return F.floor(c * p + F.lit(Decimal("0.5"))) / p
    raise ValueError(f"unknown rounding mode {mode!r}")


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), as_col(c)))


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_int(c, accept_float_text: bool = True, dash_zero: bool = False) -> Column:
    """Text → bigint. ``accept_float_text`` allows ``'703448.0'`` → 703448
    (truncating); otherwise only plain integers parse. ``dash_zero`` maps a
    lone ``'-'`` to 0. Anything else unparseable is NULL."""
    t = F.trim(as_col(c).cast("string"))
    if accept_float_text:
        d = nan_to_null(t.try_cast("double"))
        val = F.when(F.abs(d) < F.lit(9.2e18), d.cast("long"))
    else:
        val = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    if dash_zero:
        val = F.when(t == "-", F.lit(0).cast("long")).otherwise(val)
    return val


def safe_float(c) -> Column:
    """Text → double; blank, ``nan``, ``#N/A`` and garbage become NULL."""
    t = F.trim(as_col(c).cast("string"))
    return F.when(t.isin(*FLOAT_MISSING), F.lit(None).cast("double")).otherwise(nan_to_null(t.try_cast("double")))


def safe_timestamp(c) -> Column:
    """ISO text → timestamp, a trailing ``Z`` dropped; bad text → NULL."""
    t = F.regexp_replace(F.trim(as_col(c).cast("string")), "Z$", "")
    t = F.regexp_replace(t, "T", " ")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def safe_date(c) -> Column:
    """Date from the first 10 characters of the text; bad text → NULL."""
    return F.try_to_date(F.substring(F.trim(as_col(c).cast("string")), 1, 10), "yyyy-MM-dd")


def blank_to_null(c) -> Column:
    c = as_col(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


CASTERS = {
    "int": lambda c: safe_int(c, accept_float_text=True),
    "int_strict": lambda c: safe_int(c, accept_float_text=False),
    "int_dash0": lambda c: safe_int(c, accept_float_text=True, dash_zero=True),
    "float": safe_float,
    "timestamp": safe_timestamp,
    "date": safe_date,
    "text": blank_to_null,
}


def mean(c) -> Column:
    """``sum / count`` as a double (NULL on no rows). With exact decimal input
    the sum is exact, so the result is one correctly rounded division — the
    same number any engine computes from the same sum and count."""
    c = as_col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
