"""Whole sorts in which every row knows its place, and pages at any depth.

A table is range-partitioned and sorted once, and written.  While a sorted partition is written its rows are counted off, so a row
carries (partition, number in it) in one long.  The partitions' sizes, one row each, give by prefix sums the place where each
partition begins.  No window spans the table, and equal sort values may be any share of it: the tie column splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from labelspark.stage import Stages

_ROW_BITS = 33  # of a position, as monotonically_increasing_id() divides it
_AT, _PART = "_position", "_partition"


class Placed:
    """A sorted table: all rows with their places, and single pages of it."""

    def __init__(self, sorted_rows: DataFrame, bases: DataFrame):
        self._rows, self._bases = sorted_rows, bases

    def rows(self, name: str = "place") -> DataFrame:
        """Every row with its place, counted from 1."""
        number = F.col(_AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        joined = self._rows.withColumn(_PART, F.shiftright(_AT, _ROW_BITS)).join(self._bases.select(_PART, "_base"), _PART)
        return joined.withColumn(name, F.col("_base") + number + 1).drop(_AT, _PART, "_base")

    def page(self, number: int, size: int, name: str = "place") -> DataFrame:
        """The rows of one page (from 1) with their places.

        The partitions that the page touches (at most ``size``, mostly one) turn into position ranges, which the scan
        skips files and row groups by: the last page costs no more than the first.
        """
        low, high = (number - 1) * size, number * size
        touched = self._bases.filter((F.col("_base") < high) & (F.col("_base") + F.col("_rows") > low)).orderBy("_base").collect()
        found: Column = F.lit(False)
        place: Column = F.lit(None).cast("long")
        for part in touched:
            start = part[_PART] << _ROW_BITS
            first, last = start + max(0, low - part["_base"]), start + min(part["_rows"], high - part["_base"]) - 1
            inside = F.col(_AT).between(first, last)
            found = found | inside
            place = F.when(inside, F.col(_AT) - F.lit(start - part["_base"] - 1)).otherwise(place)
        return self._rows.filter(found).withColumn(name, place).drop(_AT)

    def pages(self, size: int) -> int:
        """How many pages there are, one at least."""
        rows = self._bases.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
        return max(1, -(-rows // size))


def placed(df: DataFrame, order: list[Column], stages: Stages | None = None) -> Placed:
    """``df`` in a whole sort.

    Rows that are equal in ``order`` take their places in the order in which they were read, which may differ between runs; end
    ``order`` with a key where that matters.  An empty table has no rows and one (empty) page.
    """
    stages = stages or Stages(df.sparkSession)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie")
    rows = stages.write(ranged.drop("_tie").withColumn(_AT, F.monotonically_increasing_id()), "sorted")
    counts = rows.groupBy(F.shiftright(_AT, _ROW_BITS).alias(_PART)).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per sorted partition
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    bases = stages.write(counts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "bases")
    return Placed(rows, bases)
