"""Numbering rows within groups without a task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from labelspark.llm.storage import write_table


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that no name of its columns meets a name of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The named columns of ``row``, and more."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with a column ``name``: gapless numbers from ``start`` within each group, in the given order.

    Rows are range-sorted by group and order, counted by sorted partition, and numbered within it, so a group may be of any
    size.  Equal rows are told apart by where they were read, so they do not gather in one partition either.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*groups, *order, "_tie").withColumn("_part", F.spark_partition_id())
    ranged = write_table(ranged, "ranged")  # written once, so the partition numbers hold
    counts = ranged.groupBy(*groups, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_part").alias("_of_part"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups] + [F.col("_part") == F.col("_of_part")]
    within = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order, "_tie"))
    joined = ranged.join(bases, reduce(lambda a, b: a & b, same))
    return joined.withColumn(name, (F.col("_base") + within - 1 + start).cast("long")).select(*df.columns, name)
