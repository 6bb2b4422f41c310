"""Imports every query module so that the registry is complete."""

from rangelake.plans import (  # noqa: F401
    angle_queries, cluster_queries, detect_queries, passive_queries, recipe_queries, signal_queries, source_queries, stream_queries, time_queries,
)
from rangelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
