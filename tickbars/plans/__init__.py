"""Registered queries over the given tables, each with its SQL counterpart."""

from tickbars.plans import bars, feeds, fields, gaps, journal, live, ops, quotes, raw, wire  # noqa: F401
from tickbars.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
