from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c, sentinels=()) -> Column:
    """``c IS NOT NULL AND c <> ''`` (and not one of the sentinel strings)."""
    c = as_col(c)
    cond = c.isNotNull() & (c != "")
    for s in sentinels:
        cond = cond & (c != s)
    return cond


def last_of_key(value, order=None) -> Column:
    """Aggregate: the value of a key's last row by ``order``. Without an order a
    key may have one row only; more are an error, not an arbitrary choice."""
    if order is not None:
        return F.max_by(as_col(value), as_col(order))
    several = F.raise_error(F.lit("several rows for one key need an order"))
    return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.max(as_col(value)))
