"""Importing this package registers every query."""

from ledgerlark.plans import cleaning, customers, forecast, metrics, monitoring, relations, rootcause, storage  # noqa: F401
from ledgerlark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
