"""Shared building blocks: settled tables, skew-proof lookups, exact ranks."""

from cohortal.core.lookup import lookup
from cohortal.core.ranks import (
    cut_per_group,
    nth_values,
    quantile_table,
    quantiles,
    running_totals,
    value_counts,
)
from cohortal.core.settle import scratch_dir, settle
from cohortal.core.keys import sample_key

__all__ = [
    "cut_per_group", "lookup", "nth_values", "quantile_table", "quantiles",
    "running_totals", "sample_key", "scratch_dir", "settle", "value_counts",
]
