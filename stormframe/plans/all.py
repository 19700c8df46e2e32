"""Importing this module registers every query."""

from stormframe.plans import actions, forecasts, lists, reads, scores, streams  # noqa: F401
from stormframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
