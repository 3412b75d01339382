"""Importing this module registers every plan."""

from strata.plans import classification, cleaning, distributions, models, oddvalues, profiling, roundtrip, wide  # noqa: F401
from strata.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
