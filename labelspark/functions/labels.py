"""Label, band and category columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelspark import constants as C
from labelspark.functions.names import contains_any


def lookup(value: Column, labels: dict[str, str], default: str) -> Column:
    """A keyed text lookup with a default (also for NULL)."""
    out = F.lit(default)
    for key, label in reversed(labels.items()):
        out = F.when(value == key, F.lit(label)).otherwise(out)
    return out


def job_status_label(status: Column) -> Column:
    return lookup(status, C.JOB_STATUS_LABELS, C.JOB_STATUS_DEFAULT)


def review_label(status: Column) -> Column:
    return lookup(status, C.REVIEW_LABELS, C.REVIEW_LABELS[C.REVIEW_DEFAULT])


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Ja").otherwise("Nein")


def failure_category(message: Column) -> Column:
    """The first rule whose words occur in the log message; NULL counts as other."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(C.FAILURE_DEFAULT)
    for name, words in reversed(C.FAILURE_RULES):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 70, "high").when(confidence >= 40, "medium").when(confidence.isNotNull(), "low")


def main_sum(renewable: Column, fossil: Column, nuclear: Column) -> Column:
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in (fossil, nuclear)),
               F.coalesce(renewable.cast("double"), F.lit(0.0)))


def sum_is_plausible(total: Column) -> Column:
    return total.between(95, 105)


def sum_warning(total: Column) -> Column:
    """Warn only about sums that are there at all."""
    return ~sum_is_plausible(total) & (total > 0)
