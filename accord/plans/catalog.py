"""Every registered query of the engine and its SQL twin."""

from accord.plans import joins, metrics, more, rankings, scans  # noqa: F401
from accord.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
