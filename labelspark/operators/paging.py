"""Sorting, paging and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def priority_order() -> list[Column]:
    """Highest priority first; missing priorities come first, as a descending sort in SQL databases gives."""
    return [F.col("priority").desc_nulls_first(), F.col("id").asc()]


def by_priority(df: DataFrame) -> DataFrame:
    return df.orderBy(*priority_order())


def sort_key(column: str, descending: bool, collation: str | None = None) -> Column:
    """A user-chosen sort: NULLs last in both directions, text optionally by a collation such as ``de``."""
    col = F.collate(F.col(column), collation) if collation else F.col(column)
    return col.desc_nulls_last() if descending else col.asc_nulls_last()


def user_order(column: str, descending: bool = False, collation: str | None = None, tie: str = "id") -> list[Column]:
    return [sort_key(column, descending, collation), F.col(tie).asc()]


def sort_by(df: DataFrame, column: str, descending: bool = False, collation: str | None = None,
            tie: str = "id") -> DataFrame:
    return df.orderBy(*user_order(column, descending, collation, tie))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted table, as a bounded top-k; for far pages use :func:`page_after` (next page) or
    :func:`labelspark.operators.places.placed` (any page)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, column: str, descending: bool, size: int, last_value=None, last_id: int | None = None,
               tie: str = "id") -> DataFrame:
    """The page after a known last row: the filter is pushed down and the top-k keeps only ``size`` rows,
    however deep the page lies."""
    if last_id is not None:
        col, tied = F.col(column), F.col(tie) > last_id
        if last_value is None:
            df = df.filter(col.isNull() & tied)
        else:
            beyond = col < F.lit(last_value) if descending else col > F.lit(last_value)
            df = df.filter(beyond | ((col == F.lit(last_value)) & tied) | col.isNull())
    return df.orderBy(sort_key(column, descending), F.col(tie).asc()).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("long").alias("pages"))


def recent(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col(id_col).desc_nulls_first()).limit(n)


def recent_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of every key.  The rank limit is applied inside every map task before the
    shuffle, so a hot key sends at most n rows per task."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def work_queue(providers: DataFrame, latest: DataFrame, n: int) -> DataFrame:
    """Active suppliers whose newest job is missing or not successful, most important first."""
    status = latest.select(F.col("provider_id").alias("id"), "latest_job_status")
    waiting = (
        providers.filter("active").join(status, "id", "left")
        .filter(F.col("latest_job_status").isNull() | (F.col("latest_job_status") != "success"))
    )
    return by_priority(waiting).limit(n)


def typeahead(df: DataFrame, text: str, chosen: list[int] | DataFrame, n: int = 5) -> DataFrame:
    """The first n suppliers whose name contains the text and that are not chosen yet."""
    hits = df.filter(F.lower(F.coalesce("name", F.lit(""))).contains(text.lower()))
    if isinstance(chosen, DataFrame):
        hits = hits.join(chosen.select("id").distinct(), "id", "left_anti")
    elif chosen:
        hits = hits.filter(~F.col("id").isin(chosen))
    return hits.orderBy("id").limit(n)


def newest_first(*tie: str) -> list[Column]:
    """Newest year first, then newest entry; missing values come first."""
    return [F.col(c).desc_nulls_first() for c in ("sort_year", "created_at", *tie)]


def archive_order(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(*newest_first(*tie))


def notes_of(notes: DataFrame, key: str, value, ts: str = "created_at") -> DataFrame:
    """The notes of one supplier, newest first."""
    return notes.filter(F.col(key) == value).orderBy(F.col(ts).desc_nulls_first())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
