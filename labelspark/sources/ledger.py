"""Supplier ledgers: comma-separated lines without quoting, one header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelspark.functions.numbers import leading_integer, leading_number
from labelspark.functions.plan import settle
from labelspark.operators.joins import match_ledger
from labelspark.operators.merge import upsert
from labelspark.stage import Results, Stages

FIELDS = ["anbieter_name", "berichtsjahr", "strommenge_mwh", "hkn_land", "hkn_menge_mwh"]
_BLANKS = " \t\n\x0b\f\r"
_NEVER = ("\ufffe", "\uffff", "\ufdd0")  # noncharacters


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The data lines of ledger files as (ledger_id, line_no, line): trimmed, without blank lines and headers.

    The scan itself drops the first non-blank line where a file starts, so nothing is shuffled and large files are read in
    many tasks.  The lines go through the CSV reader as one field each; its separator and quote are noncharacters, which no text holds.
    ``line_no`` orders the lines of a file: the start of the block, then the order inside the block.  A line of ASCII blanks
    and control characters before the header counts as blank; a file whose first task (128 MB by default) holds nothing else would
    keep its header.
    """
    options = {"header": True, "sep": _NEVER[0], "quote": _NEVER[1], "lineSep": "\n", "nullValue": _NEVER[2], "emptyValue": _NEVER[2],
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxCharsPerColumn": -1, "enforceSchema": True}
    lines = spark.read.schema("line string").options(**options).csv(path).select(
        F.col("_metadata.file_path").alias("ledger_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.col("line"),
    )
    return _filled(lines)


def _filled(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.btrim("line", F.lit(_BLANKS))).filter(F.col("line") != "")


def data_lines(lines: DataFrame, stages: Stages | None = None) -> DataFrame:
    """The data lines of ledgers kept as rows (ledger_id, line_no, line): trimmed, without blanks and each ledger's first line.

    The header's place, one row per ledger, is a table of ``stages``: its size is known when the lines are joined, so while it is
    small the lines stay where they are.
    """
    stages = stages or Stages(lines.sparkSession)
    rows = _filled(lines)
    headers = stages.write(rows.groupBy("ledger_id").agg(F.min("line_no").alias("line_no")), "headers")
    # the line number is part of the key, so one huge ledger spreads over all tasks
    return rows.join(headers, ["ledger_id", "line_no"], "left_anti")


def read_fields(lines: DataFrame) -> DataFrame:
    """Data lines with their typed fields, and ``reason`` where one is missing (``field``) or cannot be read (``number``)."""
    parts = F.split("line", ",", -1)
    rows = settle(lines, {"_f": parts})
    rows = rows.select("ledger_id", "line_no", "line", *[F.get("_f", i).alias(f) for i, f in enumerate(FIELDS)])
    rows = settle(rows, {
        "year": leading_integer(F.col("berichtsjahr")),
        "delivered_volume_mwh": leading_number(F.col("strommenge_mwh")).try_cast("decimal(15,2)"),
        "amount_mwh": leading_number(F.col("hkn_menge_mwh")).try_cast("decimal(15,2)"),
        "country": F.trim("hkn_land"),
    })
    missing: Column = F.lit(False)
    for field in FIELDS:
        missing = missing | (F.coalesce(F.col(field), F.lit("")) == "")
    unread = F.col("year").isNull() | F.col("delivered_volume_mwh").isNull() | F.col("amount_mwh").isNull()
    return rows.withColumn("reason", F.when(missing, "field").when(unread, "number"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of data lines: a record has all five fields non-empty; further fields are ignored.

    Records whose year or amounts do not start with a number, or with one that does not fit, are rejected as well.
    """
    rows = read_fields(lines)
    good = rows.filter(F.col("reason").isNull()).select(
        "ledger_id", "line_no", "anbieter_name", "year", "delivered_volume_mwh", "country", "amount_mwh")
    return good, rows.filter(F.col("reason").isNotNull()).select("ledger_id", "line_no", "line", "reason")


def read_matched(lines: DataFrame, providers: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(records with their supplier, rejects) of data lines, which are read and matched once, into a table of ``stages``."""
    rows = read_fields(lines)
    named = rows.withColumn("anbieter_name", F.when(F.col("reason").isNull(), F.col("anbieter_name")))
    kept = ["ledger_id", "line_no", "anbieter_name", "year", "delivered_volume_mwh", "country", "amount_mwh", "provider_id", "reason"]
    line = F.when(F.col("reason").isNotNull(), F.col("line")).alias("line")
    read = stages.write(match_ledger(named, providers).select(*kept, line), "ledger")
    return read.filter("reason is null"), read.filter("reason is not null").select("ledger_id", "line_no", "line", "reason")


def import_ledger(lines: DataFrame, providers: DataFrame, deliveries: DataFrame, cancellations: DataFrame,
                  stages: Stages | None = None) -> dict[str, DataFrame]:
    """Match, merge and report a set of data lines.

    Returns the new ``delivery`` and ``cancellation`` tables, the ``unmatched`` names, the ``rejected``
    lines and a one-row ``tally``.  The lines are read and matched once, into a table of ``stages`` that all five read; so are
    the updates, as soon as ``delivery`` or ``cancellation`` is asked for.
    """
    stages = stages or Stages(lines.sparkSession)
    matched, rejects = read_matched(lines, providers, stages)
    hits = matched.filter(F.col("provider_id").isNotNull()).withColumn("_order", F.struct("ledger_id", "line_no"))
    unmatched = matched.filter(F.col("provider_id").isNull()).groupBy("anbieter_name").agg(
        F.count(F.lit(1)).alias("lines")).withColumn(
        "message", F.concat(F.lit('Anbieter nicht gefunden: "'), F.col("anbieter_name"), F.lit('"')))
    merges = {
        "delivery": (deliveries, ["provider_id", "year"], "delivered_volume_mwh"),
        "cancellation": (cancellations, ["provider_id", "year", "country"], "amount_mwh"),
    }
    return Results({
        **{name: lambda base=base, keys=keys, value=value: upsert(base, hits.select(*keys, value, "_order"), keys, "_order", stages)
           for name, (base, keys, value) in merges.items()},
        "unmatched": lambda: unmatched,
        "rejected": lambda: rejects,
        "tally": lambda: tally(matched, rejects),
    })


def tally(matched: DataFrame, rejects: DataFrame) -> DataFrame:
    """Imported and failed lines."""
    flags = matched.select(F.col("provider_id").isNotNull().alias("ok")).unionByName(rejects.select(F.lit(False).alias("ok")))
    return flags.agg(F.count_if("ok").alias("imported"), F.count_if(~F.col("ok")).alias("failed"))
