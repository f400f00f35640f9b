"""Driver queries: one for each operator, each with its SQL where SQL can say it."""

from vellumark.queries import actions, content, fetching, relational  # noqa: F401
from vellumark.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
