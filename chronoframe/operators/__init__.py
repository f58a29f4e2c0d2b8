"""Operator families: clean (P), aggs (A), joins (J), series (W),
shape (R, T, U) and loads (K)."""

from chronoframe.operators import aggs, clean, joins, loads, series, shape

__all__ = ["aggs", "clean", "joins", "loads", "series", "shape"]
