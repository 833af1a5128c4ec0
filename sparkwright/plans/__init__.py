"""Named query plans over the test tables (``queries()``) and their SQL oracles."""

from sparkwright.plans.registry import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
