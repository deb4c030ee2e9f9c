"""Queries and oracle SQL by registered name."""

from .plans import more, tools  # noqa: F401 - they register their queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
