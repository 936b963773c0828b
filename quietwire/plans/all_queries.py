"""All registered queries."""

from quietwire.plans import base_queries, route_queries, text_queries  # noqa: F401
from quietwire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
