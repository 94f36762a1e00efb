"""Every registered query with its oracle."""

from cohortal.catalog import scans, nested, missing, features, sampling, selection, gates, reports, models  # noqa: F401
from cohortal.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
