"""Importing this module registers every query."""

from churnlake.plans import (  # noqa: F401
    modelling, preparing, profiling, relational, scoring, texts)
from churnlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
