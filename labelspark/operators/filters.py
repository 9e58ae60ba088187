"""Row filters over suppliers, snapshots and reconciliations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.labels import failure_category
from labelspark.functions.names import contains_any


def _empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def search(df: DataFrame, text: str, columns: tuple[str, ...] = ("name", "city", "zip", "file_number")) -> DataFrame:
    """Rows in which any of the columns contains the text, ignoring case."""
    needle = text.lower()
    hits = [F.lower(_empty(c)).contains(needle) for c in columns if c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def by_job_status(df: DataFrame, status: str) -> DataFrame:
    """``never`` selects suppliers without any job."""
    if status == "all":
        return df
    col = F.col("latest_job_status")
    return df.filter(col.isNull() if status == "never" else col == status)


def by_data(df: DataFrame, kind: str) -> DataFrame:
    rules = {
        "all": F.lit(True),
        "with_data": F.col("last_mix_year").isNotNull(),
        "no_data": F.col("last_mix_year").isNull(),
        "low_confidence": F.col("last_confidence") < 40,
        "source_check": F.col("has_unverified_source"),
        "duplicate": F.col("has_duplicate_doc"),
    }
    return df.filter(rules[kind]) if kind != "all" else df


def by_review(df: DataFrame, status: str) -> DataFrame:
    """A missing review status counts as open."""
    return df if status == "all" else df.filter(F.coalesce("review_status", F.lit(C.REVIEW_DEFAULT)) == status)


def by_city(df: DataFrame, city: str) -> DataFrame:
    """The text is taken literally: ``%`` and ``_`` are no wildcards."""
    needle = city.strip().lower()
    return df.filter(F.lower("city").contains(needle)) if needle else df


def by_mix_year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else df.filter(F.col("last_mix_year") == year)


def by_failure(df: DataFrame, category: str) -> DataFrame:
    return df.filter((F.col("latest_job_status") == "failed") & (failure_category(F.col("latest_job_log")) == category))


def by_ids(df: DataFrame, ids: list[int] | DataFrame, key: str = "id") -> DataFrame:
    """A short list becomes a pushed-down IN filter; a table of ids becomes a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(ids))


def reconciliation(df: DataFrame, text: str = "", status: str = "all", direction: str = "all",
                   threshold: float | None = None) -> DataFrame:
    """The filter of the reconciliation list: text, verdict, direction and size of the deviation."""
    if text:
        df = search(df, text, ("provider_name", "file_number"))
    if status != "all":
        df = df.filter(F.col("audit_status") == status)
    if direction == "under":
        df = df.filter(F.col("difference_mwh") < 0)
    elif direction == "over":
        df = df.filter(F.col("difference_mwh") > 0)
    if threshold is not None:
        df = df.filter(F.abs("deviation_percent") >= threshold)
    return df


def mentions_any(df: DataFrame, words: list[str], columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows in which any column contains any of the words, ignoring case."""
    hits = [contains_any(F.lower(_empty(c)), words) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def invalid_names(df: DataFrame) -> DataFrame:
    return mentions_any(df, C.INVALID_NAME_WORDS, ("name",))


def test_names(df: DataFrame) -> DataFrame:
    return mentions_any(df, C.TEST_DATA_WORDS, ("name", "city"))


def garbage_name(name: Column) -> Column:
    """Header or footer text that was read as a supplier name (case matters)."""
    return name.contains("Strom") | name.contains("Gas") | (F.length(name) < 3) | name.startswith("Stand ")


def log_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("log_message").startswith(prefix))


def changed(old: Column, new: Column) -> Column:
    """Two values differ, where NULL equals NULL."""
    return ~old.eqNullSafe(new)
