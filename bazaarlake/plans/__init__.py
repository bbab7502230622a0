"""Registered queries of the marketplace operators."""

from bazaarlake.plans import fuzzy, ingest, lines, search, training  # noqa: F401  (registers its queries)
from bazaarlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
