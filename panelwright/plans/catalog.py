"""All registered queries."""

from . import model_queries, stat_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
