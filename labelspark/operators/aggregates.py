"""Counts, sums, histograms and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark.functions.labels import failure_category
from labelspark.functions.numbers import round_half_up, zero_if_null
from labelspark.operators.latest import latest_jobs


def count_per_provider(providers: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Number of child rows per supplier, zero when there are none."""
    counts = children.groupBy(F.col("provider_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    return providers.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def status_distribution(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs")).orderBy(F.desc("jobs"), "status")


def cancelled_totals(cancellations: DataFrame, year: int | None = None) -> DataFrame:
    """Cancelled volume per supplier and year."""
    rows = cancellations if year is None else cancellations.filter(F.col("year") == year)
    return rows.groupBy("provider_id", "year").agg(F.sum("amount_mwh").alias("ist_mwh"))


def list_total(cancellations: Column) -> Column:
    """Sum over a nested list of cancellations."""
    return F.aggregate(cancellations, F.lit(0.0), lambda acc, c: acc + c["amount_mwh"].cast("double"))


def key_figures(snapshot: DataFrame) -> DataFrame:
    """One row of overview counts."""
    status = F.col("latest_job_status")
    return snapshot.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "success").alias("success"),
        F.count_if(F.col("last_mix_year").isNotNull()).alias("with_mix"),
        F.count_if(status == "running").alias("running"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(F.coalesce(status != "success", F.lit(True))).alias("incomplete"),
    )


def failure_histogram(jobs: DataFrame) -> DataFrame:
    """Why the newest jobs failed, most frequent reason first, with the overall number of failures."""
    failed = latest_jobs(jobs).filter(F.col("latest_job_status") == "failed")
    per_reason = failed.groupBy(failure_category(F.col("latest_job_log")).alias("category")).agg(
        F.count(F.lit(1)).alias("failures"))
    return per_reason.orderBy(F.desc("failures"), "category")


def failure_total(jobs: DataFrame) -> DataFrame:
    return latest_jobs(jobs).agg(F.count_if(F.col("latest_job_status") == "failed").alias("failures"))


def mean_renewable(snapshot: DataFrame) -> DataFrame:
    """Row count and rounded mean renewable share (missing counts as zero; no rows give zero)."""
    mean = round_half_up(F.avg(zero_if_null(F.col("last_renewable_percentage"))), 0)
    return snapshot.agg(
        F.count(F.lit(1)).alias("providers"), F.coalesce(mean, F.lit(0.0)).cast("long").alias("mean_renewable"))


def table_metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one result."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("metric"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def merge_amounts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Amounts per country regardless of case; the spelling of the first entry is shown."""
    return (
        rows.groupBy(*keys, F.lower(F.trim("country")).alias("_country"))
        .agg(F.min_by(F.trim("country"), F.struct(order, F.trim("country"))).alias("country"),
             F.sum("amount_mwh").alias("amount_mwh"))
        .drop("_country")
    )


def part_sum(df: DataFrame, parts: list[str]) -> Column:
    """Horizontal sum in the given order, missing values as zero."""
    out = F.lit(0.0)
    for part in parts:
        if part in df.columns:
            out = out + zero_if_null(F.col(part))
    return out
