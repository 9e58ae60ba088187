"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns that are evaluated once per row.

    The optimizer moves filters below projections by copying the expressions they test.  For long
    expressions that are used many times (an address behind a redirect, say) the copies multiply until
    the plan no longer compiles.  A one-element generator stops that without any shuffle.
    """
    rest = [c for c in df.columns if c not in columns]
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*rest, F.explode(F.array(packed)).alias("_settled")).select(*rest, "_settled.*")
