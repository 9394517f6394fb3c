"""All query modules, and the tables of queries that they fill."""

from screenlake.plans import aggregates, graphs, joins, layout, predicates, quality, repair, sources, streams, texts  # noqa: F401
from screenlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
