"""All queries of the engine with their DuckDB statements."""

from millrace.plans import parts  # noqa: F401  registers its queries
from millrace.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
