"""Queries over the tables of a data folder; importing this package registers them all."""

from vecloom.plans import features, graphs, neighbors, retrieval, training  # noqa: F401
from vecloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
