"""Scalar column builders shared by the operators."""

from chronoframe.functions import exact
from chronoframe.functions.common import as_col, not_blank
from chronoframe.functions.dates import (
    bigint_ts_to_date, bucket, date_to_int, int_to_date, month_key, parse_first_format, parse_mixed_date, to_day,
)
from chronoframe.functions.exact import carried, exact_number, limb, outer_limbs
from chronoframe.functions.numeric import (
    CASTERS, blank_to_null, clip, guarded_numeric, mean, nan_to_null, round_to, safe_date, safe_float, safe_int,
    safe_timestamp,
)
from chronoframe.functions.text import icontains, truncate_text

__all__ = [
    "as_col", "not_blank", "bigint_ts_to_date", "bucket", "date_to_int", "int_to_date", "month_key",
    "parse_first_format", "parse_mixed_date", "to_day", "CASTERS", "blank_to_null", "clip", "guarded_numeric",
    "mean", "nan_to_null", "round_to", "safe_date", "safe_float", "safe_int", "safe_timestamp", "icontains",
    "truncate_text", "exact", "carried", "exact_number", "limb", "outer_limbs",
]
