"""Report and export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.labels import job_status_label, review_label, yes_no
from labelspark.functions.numbers import plain_number
from labelspark.operators.aggregates import mean_renewable
from labelspark.operators.paging import by_priority

BOM = "\ufeff"


def safe_cell(text: Column) -> Column:
    """A quoted cell; text that a spreadsheet would run as a formula gets a leading apostrophe."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""'))
    guarded = F.when(body.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), body)).otherwise(body)
    return F.concat(F.lit('"'), guarded, F.lit('"'))


def csv_line(snapshot: DataFrame) -> Column:
    """The 17 cells of a snapshot row, separated by semicolons."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in snapshot.columns else F.lit("")

    def number(name: str) -> Column:
        return F.coalesce(plain_number(F.col(name)), F.lit(""))

    cells = [
        text("id"), safe_cell(F.col("name")), safe_cell(F.col("city")), text("zip"), text("file_number"),
        F.coalesce(F.col("priority"), F.lit(50)).cast("string"), yes_no(F.col("active")), text("last_mix_year"),
        number("last_renewable_percentage"), number("last_fossil_percentage"), number("last_nuclear_percentage"),
        number("co2_emission_g_kwh"), text("last_confidence"), text("last_extraction_method"),
        job_status_label(F.col("latest_job_status")), review_label(F.col("review_status")),
        F.coalesce(F.col("document_count"), F.lit(0)).cast("string"),
    ]
    return F.concat_ws(";", *cells)


def csv_lines(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("id", csv_line(snapshot).alias("line"))


def write_csv(snapshot: DataFrame, path: str) -> None:
    """Byte-order mark and header come first, then the rows by priority; one file per sorted range."""
    spark = snapshot.sparkSession
    header = spark.range(1).select(F.lit(BOM + ";".join(C.CSV_HEADER)).alias("value"))
    rows = by_priority(snapshot).select(csv_line(snapshot).alias("value"))
    header.coalesce(1).union(rows).write.mode("overwrite").text(path)


def report(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key figures, seven-column table) of a printed report."""
    dash = F.lit("-")
    detail = snapshot.select(
        "id",
        F.coalesce(F.nullif("name", F.lit("")), dash).alias("name"),
        F.coalesce(F.nullif("city", F.lit("")), dash).alias("city"),
        F.coalesce(F.col("last_mix_year").cast("string"), dash).alias("year"),
        F.concat(F.coalesce(plain_number(F.col("last_renewable_percentage")), F.lit("0")), F.lit("%")).alias("renewable"),
        F.concat(F.coalesce(plain_number(F.col("co2_emission_g_kwh")), dash), F.lit(" g/kWh")).alias("co2"),
        review_label(F.col("review_status")).alias("review"),
    )
    return mean_renewable(snapshot), detail


def json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
