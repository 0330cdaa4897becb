"""All registered queries of the library."""

from __future__ import annotations

from pagetrace.plans import health, impact, quality, reports, runs, trees  # noqa: F401  registering
from pagetrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
