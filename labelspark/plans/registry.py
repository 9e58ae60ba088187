"""The table of registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelspark.plans.views import Views, with_views

Plan = Callable[[Views], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan over the views and, where SQL can say the same, its oracle statement."""
    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(Views(spark, sf_dir))

    return {name: bind(plan) for name, plan in PLANS.items()}
