"""Registered queries: each pairs a Spark plan with, where SQL can express it, an ANSI statement."""

from plantspark.queries import checks, contracts, equipment, intake, models, search, series  # noqa: F401
from plantspark.queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
