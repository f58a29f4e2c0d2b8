"""Registered driver queries (one per operator ID of the survey) and their
DuckDB oracles."""

from chronoframe.plans import q_aggs, q_clean, q_joins, q_loads, q_series, q_shape, q_sources, q_streams  # noqa: F401  # noqa: F401  (registration)
from chronoframe.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
