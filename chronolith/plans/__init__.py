"""The SQL dialect."""

from chronolith.plans.dialect import Dialect, translate

__all__ = ["Dialect", "translate"]
