"""All registered queries in one place."""

from __future__ import annotations

from labelspark.plans import compliance, maintenance, relational, texts  # noqa: F401
from labelspark.plans.registry import ORACLES, PLANS, queries

__all__ = ["ORACLES", "PLANS", "queries"]
