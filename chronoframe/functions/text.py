"""Text helpers used by cleaning operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col


def icontains(c, pattern: str) -> Column:
    """Case-insensitive regex search; NULL input counts as no match."""
    return F.coalesce(as_col(c).rlike(f"(?i){pattern}"), F.lit(False))


def truncate_text(c, limit: int, keep: int | None = None, suffix: str = "...") -> Column:
    """First ``keep`` chars + suffix when longer than ``limit`` chars."""
    c = as_col(c)
    keep = limit if keep is None else keep
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(suffix))).otherwise(c)
