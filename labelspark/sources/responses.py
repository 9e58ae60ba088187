"""Stored model responses to typed mix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark.functions.plan import settle
from labelspark.operators.quality import penalised_confidence, with_issues

_DOUBLES = [
    "renewable", "fossil", "nuclear", "solar", "wind", "hydro", "biomass", "other_renewable", "coal", "natural_gas",
    "other_fossil", "eeg_funded", "mieterstrom", "co2", "eeg_percentage",
]
_STRINGS = ["mix_type", "tariff_name", "company_name", "company_address", "company_zip", "company_city"]
_ORIGINS = "array<struct<country:string,percentage:double>>"


def normalise(responses: DataFrame, column: str = "raw_response") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects).  Code fences are removed; a response that is no JSON object, or that says the
    document is no label, is a reject.  Older field names are mapped, checks and the confidence penalty
    are applied."""
    clean = F.trim(F.regexp_replace(column, "```json|```", ""), F.lit(" \t\r\n"))
    # One pass reads all plain fields as text; the variant is for the two whose JSON type counts.
    fields = ", ".join(f"{f} string" for f in [*_DOUBLES, *_STRINGS, "year", "waste", "radioactive_waste", "hkn", "ee_with_hkn", "confidence"])
    parsed = settle(settle(responses, {"_json": clean}), {"_v": F.try_parse_json("_json"), "_f": F.from_json("_json", fields)})

    def number(name: str) -> Column:
        return F.col(f"_f.{name}").try_cast("double")

    is_object = F.coalesce(F.col("_v").isNotNull() & F.col("_json").startswith("{"), F.lit(False))
    # only the boolean refuses, not a text that says the same
    stated = F.try_variant_get("_v", "$.is_skz", "variant")
    refused = F.coalesce((F.schema_of_variant(stated) == "BOOLEAN") & ~F.try_variant_get("_v", "$.is_skz", "boolean"), F.lit(False))
    parsed = settle(parsed, {"_reason": F.when(~is_object, "json").when(refused, "no_label")})
    columns = {f: number(f) for f in _DOUBLES} | {f: F.col(f"_f.{f}") for f in _STRINGS}
    columns |= {
        "year": number("year").try_cast("int"),
        "waste": F.coalesce(number("waste"), number("radioactive_waste")),
        "hkn": F.coalesce(number("hkn"), number("ee_with_hkn")),
        "hkn_origins": F.try_variant_get("_v", "$.hkn_origins", _ORIGINS),
        "confidence": number("confidence").try_cast("int"),
    }
    rows = settle(parsed.filter(F.col("_reason").isNull()), columns).drop("_v", "_f", "_json", "_reason")
    checked = with_issues(rows)
    checked = checked.withColumn("confidence", penalised_confidence(F.col("confidence"), F.col("is_valid")))
    rejects = parsed.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason").drop("_v", "_f", "_json")
    return checked, rejects
