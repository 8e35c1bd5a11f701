"""All registered queries."""

from plotline.plans import geocoding, ingest, linking, reports, rows, searches  # noqa: F401
from plotline.plans.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
