"""All named queries."""

from __future__ import annotations

from leadflow.plans import campaigning, contacts, listings, relational, textual  # noqa: F401  each registers its queries
from leadflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
