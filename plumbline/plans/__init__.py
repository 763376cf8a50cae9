from . import bin_queries, index_queries, metric_queries, profile_queries  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
