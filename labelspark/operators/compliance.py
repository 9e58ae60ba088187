"""Reconciliation of declared certificate shares with cancelled volumes, in exact decimals from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark.functions.numbers import fixed, ratio_half_up
from labelspark.operators.aggregates import cancelled_totals
from labelspark.operators.joins import year_star

VOLUME = (25, 6)  # digits of a volume in MWh, expected or cancelled


def difference(expected: Column, actual: Column) -> Column:
    return (fixed(actual, *VOLUME) - fixed(expected, *VOLUME)).cast("decimal(26,6)")


def deviation_percent(expected: Column, actual: Column) -> Column:
    """Relative deviation in percent, halves of a hundredth away from zero; zero when nothing was expected."""
    hundredfold = (difference(expected, actual) * F.lit(100).cast("decimal(3,0)")).cast("decimal(28,6)")
    return F.coalesce(ratio_half_up(hundredfold, fixed(expected, *VOLUME), 2), F.lit(0).cast("decimal(34,2)"))


def reconcile(rows: DataFrame) -> DataFrame:
    """Expected against cancelled volume for the rows of a year star that carries ``ist_mwh``."""
    columns = rows.columns
    rows = rows.withColumns({
        **{c: fixed(F.col(c) if c in columns else F.lit(None), 5, 2) for c in ("hkn_percentage", "renewable_percentage", "eeg_percentage")},
        "delivered_volume_mwh": fixed(F.col("delivered_volume_mwh"), 15, 2),
        "ist_mwh": fixed(F.col("ist_mwh"), *VOLUME),
        "audit_status": F.coalesce("audit_status", F.lit("offen")),
    })
    hkn, volume, ist = F.col("hkn_percentage"), F.col("delivered_volume_mwh"), F.col("ist_mwh")
    hundredth = F.lit("0.01").cast("decimal(2,2)")
    rows = rows.withColumn("soll_mwh", (hkn * volume * hundredth).cast("decimal(25,6)"))
    soll = F.col("soll_mwh")
    # the cancelled share less the declared one, over one denominator, so that it is rounded once
    apart = (ist * F.lit(100).cast("decimal(3,0)") - hkn * volume).cast("decimal(29,6)")
    points = F.when(volume > 0, ratio_half_up(apart, volume.cast("decimal(21,6)"), 2)).otherwise((-hkn).cast("decimal(34,2)"))
    return rows.withColumns({
        "difference_mwh": difference(soll, ist), "deviation_percent": deviation_percent(soll, ist), "mix_point_diff": points})


def reconciliation(providers: DataFrame, deliveries: DataFrame, documents: DataFrame, mixes: DataFrame,
                   audits: DataFrame, cancellations: DataFrame, year: int, latest_only: bool = False) -> DataFrame:
    """The whole reconciliation of one year in one plan; cancellations are summed before they are joined."""
    totals = cancelled_totals(cancellations, year).select("provider_id", "ist_mwh")
    return reconcile(year_star(providers, deliveries, documents, mixes, audits, year, latest_only, totals))


def direction(diff: Column) -> Column:
    return F.when(diff < 0, "under").when(diff > 0, "over").otherwise("balanced")


def country_comparison(declared: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Per supplier, year and country: declared and cancelled share of all certificates, and how far they are apart.

    ``declared``: provider_id, year, country, percentage (of the supplier's labels of that year; repeated countries add up).
    ``cancelled``: provider_id, year, country, amount_mwh.  Countries are compared trimmed and without case, and shown as
    first in order.  A full outer join: a country that only one side knows has NULL on the other.  Shares are of the side's total of
    supplier and year, in percent to two digits, halves away from zero; a total of zero gives no shares.
    """
    def side(rows: DataFrame, value: str, name: str) -> DataFrame:
        cut = rows.filter(F.trim(F.coalesce("country", F.lit(""))) != "").select(
            "provider_id", "year", F.trim("country").alias("_shown"), F.lower(F.trim("country")).alias("_key"), F.col(value).cast("decimal(25,6)").alias("_v"))
        each = cut.groupBy("provider_id", "year", "_key").agg(F.min("_shown").alias(f"_{name}_shown"), F.sum("_v").cast("decimal(25,6)").alias("_v"))
        whole = each.groupBy("provider_id", "year").agg(F.sum("_v").cast("decimal(25,6)").alias("_whole"))
        share = ratio_half_up((F.col("_v") * F.lit(100).cast("decimal(3,0)")).cast("decimal(28,6)"), F.col("_whole"), 2)
        return each.join(whole, ["provider_id", "year"]).select("provider_id", "year", "_key", f"_{name}_shown", share.alias(f"{name}_percent"))

    both = side(declared, "percentage", "declared").join(side(cancelled, "amount_mwh", "cancelled"), ["provider_id", "year", "_key"], "full")
    apart = F.coalesce("cancelled_percent", F.lit(0).cast("decimal(34,2)")) - F.coalesce("declared_percent", F.lit(0).cast("decimal(34,2)"))
    return both.select("provider_id", "year", F.coalesce(F.least("_declared_shown", "_cancelled_shown"), "_declared_shown", "_cancelled_shown").alias("country"),
                       "declared_percent", "cancelled_percent", apart.alias("points_apart"))
