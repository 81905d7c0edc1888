"""All queries by name."""

from wattloom.plans import eda_queries, io_queries, learning_queries, log_queries, series_queries, streaming_queries  # noqa: F401
from wattloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
