"""Date helpers: integer dates, mixed-format parsing, calendar buckets.

All parsing uses ``try_*`` forms so malformed input becomes NULL instead of
failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col

# The patterns the reference routes dates with, in its order.
DOTTED_DMY = r"^\d{2}\.\d{2}\.\d{4}"          # DD.MM.YYYY
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"            # YYYY-MM-DD...

GRAINS = ("day", "week", "month", "year")


def to_day(c) -> Column:
    """Timestamp / date / ISO text → DATE (NULL when unparseable)."""
    c = as_col(c)
    return F.to_date(c)


def int_to_date(c) -> Column:
    """``YYYYMMDD`` integer → DATE; out-of-range values give NULL."""
    return F.try_to_date(as_col(c).cast("string"), "yyyyMMdd")


def bigint_ts_to_date(c) -> Column:
    """``YYYYMMDDHHMMSS`` bigint → DATE. Integer division (not ``/``, which
    yields a double in Spark): subtracting the remainder first keeps it exact."""
    c = as_col(c).cast("long")
    day = ((c - F.pmod(c, F.lit(1000000))) / F.lit(1000000)).cast("long")
    return int_to_date(day)


def date_to_int(c) -> Column:
    """DATE → ``YYYYMMDD`` integer (keeps range predicates prunable)."""
    d = as_col(c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def bucket(c, grain: str) -> Column:
    """Calendar bucket of a date/timestamp: day, ISO week (Monday), month, year."""
    d = F.to_date(as_col(c))
    if grain == "day":
        return d
    if grain == "week":
        return F.date_trunc("week", d).cast("date")
    if grain == "month":
        return F.trunc(d, "month")
    if grain == "year":
        return F.trunc(d, "year")
    raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")


def month_key(c) -> Column:
    """``YYYY-MM`` text key of a date."""
    return F.date_format(as_col(c), "yyyy-MM")


def parse_mixed_date(c, routes, anchored_first: bool = False) -> Column:
    """Regex-routed multi-format parse.

    ``routes`` is an ordered list of ``(regex, format)``; the first regex that
    matches decides the format (``format`` None = ISO prefix, first 10 chars).
    A value matching no route, or failing its format, is NULL.
    """
    c = as_col(c)
    expr = None
    for i, (regex, fmt) in enumerate(routes):
        if anchored_first and i == 0 and not regex.endswith("$"):
            regex = regex + "$"
        if fmt is None:
            parsed = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
        else:
            parsed = F.try_to_date(c, fmt)
        cond = c.rlike(regex)
        expr = F.when(cond, parsed) if expr is None else expr.when(cond, parsed)
    return expr


def parse_first_format(c, formats) -> Column:
    """Try formats in order (strptime-style fallbacks); NULL when none fit."""
    c = F.trim(as_col(c))
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])
