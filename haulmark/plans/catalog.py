"""All registered queries."""

from . import function_queries, load_queries, sql_queries, state_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
