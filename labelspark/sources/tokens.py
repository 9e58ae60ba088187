"""Positioned text of a printed supplier list to supplier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.numbers import round_half_up


def suppliers(tokens: DataFrame) -> DataFrame:
    """Needs ``page, x, y, seq, text``.  Tokens of one printed line share page and rounded height; each
    column takes the first token inside its band.  Lines without a usable name are dropped."""
    x = F.col("x")
    columns = [
        F.min_by("text", F.when((x > low) & (x < high), F.col("seq"))).alias(field)
        for field, (low, high) in C.TOKEN_BANDS.items()
    ]
    rows = tokens.withColumn("text", F.trim("text")).groupBy(
        "page", round_half_up(F.col("y"), 1).alias("line")).agg(*columns)
    usable = F.length("name") > 2
    for noise in C.TOKEN_NOISE:
        usable = usable & ~F.col("name").contains(noise)
    return rows.filter(usable)
