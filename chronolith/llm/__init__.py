"""Training-data operators. Nothing else in the library imports this subpackage."""

from chronolith.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
