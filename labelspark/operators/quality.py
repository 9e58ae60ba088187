"""Plausibility of declared mixes, ingest gates and record validation.

Columns follow the short names ``renewable, fossil, nuclear, year, co2`` and the part names of
``constants.RENEWABLE_PARTS`` / ``FOSSIL_PARTS``; missing part columns count as NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.numbers import plain_number, round_half_up, zero_if_null
from labelspark.functions.plan import settle
from labelspark.functions.urls import source_matches
from labelspark.operators.aggregates import part_sum
from labelspark.operators.joins import trusted_flag, with_national_mix

SHORT_NAMES = {
    "renewable_percentage": "renewable", "fossil_percentage": "fossil", "nuclear_percentage": "nuclear",
    "wind_percentage": "wind", "solar_percentage": "solar", "biomass_percentage": "biomass",
    "hydro_percentage": "hydro", "other_renewable_percentage": "other_renewable", "coal_percentage": "coal",
    "natural_gas_percentage": "natural_gas", "other_fossil_percentage": "other_fossil",
    "co2_emission_g_kwh": "co2", "radioactive_waste_mg_kwh": "waste",
}


def short_names(mixes: DataFrame) -> DataFrame:
    """Table columns renamed to the names the checks use, figures as doubles."""
    present = {k: v for k, v in SHORT_NAMES.items() if k in mixes.columns}
    return mixes.withColumnsRenamed(present).withColumns({v: F.col(v).cast("double") for v in present.values()})


def _weighted(df: DataFrame, parts: list[str], parent: Column, default: int) -> tuple[Column, Column]:
    total = part_sum(df, parts)
    scale = F.least(F.lit(1.0), parent / F.nullif(total, F.lit(0.0)))
    known = [p for p in parts if p in df.columns]
    usable = (total > 0) & (parent > 0)
    terms = [F.when(usable, zero_if_null(F.col(p)) * scale * C.EMISSION_FACTORS[p]).otherwise(F.lit(0.0)) for p in known]
    return terms, F.when(usable, F.lit(0.0)).otherwise(parent * default)


def expected_co2(df: DataFrame) -> Column:
    """CO2 intensity that the declared shares suggest."""
    out = F.lit(0.0)
    for parts, parent, default in ((C.RENEWABLE_PARTS, "renewable", C.RENEWABLE_DEFAULT_FACTOR),
                                   (C.FOSSIL_PARTS, "fossil", C.FOSSIL_DEFAULT_FACTOR)):
        terms, rest = _weighted(df, parts, zero_if_null(F.col(parent)), default)
        for term in terms:
            out = out + term
        out = out + rest
    return round_half_up((out + zero_if_null(F.col("nuclear")) * C.EMISSION_FACTORS["nuclear"]) / 100, 1)


def with_issues(df: DataFrame) -> DataFrame:
    """Adds ``issues``: an array of (code, path, message, severity), and ``is_valid``: no issue is an error."""
    ee, fo, nu = (zero_if_null(F.col(c)) for c in ("renewable", "fossil", "nuclear"))
    df = settle(df, {
        "_total": round_half_up(ee + fo + nu, 2),
        "_expected": expected_co2(df),
        "_ee_parts": round_half_up(part_sum(df, C.RENEWABLE_PARTS), 2),
        "_fo_parts": round_half_up(part_sum(df, C.FOSSIL_PARTS), 2),
    })
    deviation = round_half_up(F.abs(F.col("_total") - 100), 2)
    co2 = F.col("co2").cast("double") if "co2" in df.columns else F.lit(None).cast("double")
    year = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    corridor = F.greatest(F.lit(float(C.CO2_ABS_TOLERANCE)), F.col("_expected") * C.CO2_REL_TOLERANCE)
    shown = lambda c: plain_number(c.cast("decimal(20,2)"))
    total, expected = shown(F.col("_total")), shown(F.col("_expected"))
    # Codes and texts of the issues.
    rules = [
        ("SUM_DEVIATION_ERROR", "renewable,fossil,nuclear", "error", deviation > C.SUM_TOLERANCE_ERROR,
         ["Hauptkategorien summieren sich auf ", total, "% statt 100% (Abweichung ", shown(deviation), f"% > Toleranz {C.SUM_TOLERANCE_ERROR:g}%)."]),
        ("EE_SUBCATEGORIES_EXCEED_PARENT", "renewable", "error", F.col("_ee_parts") > ee + C.PART_EPSILON,
         ["Summe der EE-Unterkategorien (", shown(F.col("_ee_parts")), "%) übersteigt Erneuerbare Energien gesamt (", shown(ee), "%)."]),
        ("FOSSIL_SUBCATEGORIES_EXCEED_PARENT", "fossil", "error", F.col("_fo_parts") > fo + C.PART_EPSILON,
         ["Summe der Fossil-Unterkategorien (", shown(F.col("_fo_parts")), "%) übersteigt Fossile Energieträger gesamt (", shown(fo), "%)."]),
        ("SUM_DEVIATION_MINOR", "renewable,fossil,nuclear", "warning",
         (deviation > C.SUM_TOLERANCE_WARNING) & (deviation <= C.SUM_TOLERANCE_ERROR),
         ["Hauptkategorien ergeben ", total, "% – leichte Abweichung von ", shown(deviation), "%."]),
        ("CO2_OUTSIDE_CORRIDOR", "co2", "warning",
         (co2 > 0) & (round_half_up(F.abs(co2 - F.col("_expected")), 1) > corridor),
         ["CO₂-Intensität (", shown(co2), " g/kWh) weicht vom Erwartungswert (", expected, " g/kWh) ab (Korridor: ±",
          shown(round_half_up(corridor, 0)), " g/kWh)."]),
        ("NUCLEAR_AFTER_PHASEOUT", "nuclear", "warning", (nu > 0.5) & (year >= C.NUCLEAR_PHASEOUT_YEAR),
         ["Kernenergie-Anteil von ", shown(nu), "% im Jahr ", year.cast("string"), " ist für Deutschland unplausibel (Atomausstieg April 2023)."]),
    ]
    found = F.array(*[
        F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"),
                                F.concat(*[F.lit(t) if isinstance(t, str) else t for t in message]).alias("message"),
                                F.lit(severity).alias("severity")))
        for code, path, severity, broken, message in rules
    ])
    df = settle(df, {"issues": F.filter(found, lambda x: x.isNotNull())})
    df = df.withColumn("is_valid", ~F.exists("issues", lambda x: x["severity"] == "error"))
    return df.drop("_total", "_ee_parts", "_fo_parts").withColumnRenamed("_expected", "expected_co2")


def issue_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """Long form: one row per record and issue."""
    return with_issues(df).select(key, F.explode("issues").alias("i")).select(key, "i.code", "i.path", "i.message", "i.severity")


def ingest_gate(df: DataFrame) -> DataFrame:
    """Caps the confidence of odd records and marks those to reject (``accepted``).

    Its thresholds differ from those of :func:`with_issues`; the two rule sets are separate on purpose.
    """
    raw = [F.col(c).cast("double") for c in ("renewable", "fossil", "nuclear")]
    ee, fo, nu = raw
    total = zero_if_null(ee) + zero_if_null(fo) + zero_if_null(nu)
    same = F.coalesce((ee == fo) & (fo == nu) & (ee > 0), F.lit(False))
    off = (total > 0) & (F.abs(total - 100) > 5)
    late = F.coalesce((nu > 5) & (F.col("year") >= 2024), F.lit(False))
    over = reduce(lambda a, b: a | b, [F.coalesce(c > 100, F.lit(False)) for c in raw])
    rules = [(same, 10, "identical"), (off, 20, "sum"), (late, 30, "nuclear"), (over, 5, "over_100")]
    confidence = F.col("confidence")
    for broken, cap, _ in rules:
        confidence = F.when(broken, F.least(confidence, F.lit(cap))).otherwise(confidence)
    warnings = F.filter(F.array(*[F.when(b, F.lit(name)) for b, _, name in rules]), lambda x: x.isNotNull())
    return settle(df, {"gate_warnings": warnings, "accepted": ~(total > 150), "confidence": confidence})


def penalised_confidence(confidence: Column, is_valid: Column) -> Column:
    """A model's own confidence (80 when it gave none), less 30 when the mix is implausible."""
    given = F.coalesce(confidence, F.lit(80))
    return F.when(is_valid, given).otherwise(F.greatest(F.lit(0), given - 30))


def compare_to_national(df: DataFrame) -> DataFrame:
    """Differences to the national mix in percentage points, with a neutral band of two points."""
    out = with_national_mix(df)
    columns = {}
    for share in ("renewable", "fossil", "nuclear"):
        diff = zero_if_null(F.col(share)) - F.col(f"national_{share}")
        columns[f"{share}_diff"] = round_half_up(diff, 1)  # shown; the band is tested on the exact figure
        columns[f"{share}_class"] = F.when(F.abs(diff) < 2, "neutral").when(diff > 0, "above").otherwise("below")
    return out.withColumns(columns)


# --- record validation ----------------------------------------------------------------------------

Rule = tuple[str, str, Column]


def _outside(col: str, low: float, high: float | None) -> Column:
    c = F.col(col)
    return (c < low) | (c > high) if high is not None else c < low


def mix_rules(df: DataFrame) -> list[Rule]:
    """(field, rule, violated) for a mix record."""
    have = set(df.columns)
    rules: list[Rule] = [
        ("provider_id", "positive", F.col("provider_id").isNull() | (F.col("provider_id") <= 0)),
        ("year", "range", F.col("year").isNull() | _outside("year", 2000, 2100)),
    ]
    if "document_id" in have:
        rules.append(("document_id", "positive", F.col("document_id") <= 0))
    rules += [(c, "range", _outside(c, 0, 100)) for c in C.MIX_SHARES if c in have]
    rules += [(c, "range", _outside(c, 0, None)) for c in ("co2_emission_g_kwh", "radioactive_waste_mg_kwh") if c in have]
    if "confidence" in have:
        rules.append(("confidence", "range", _outside("confidence", 0, 100)))
    for col, allowed in (("extraction_method", C.EXTRACTION_METHODS), ("mix_type", C.MIX_TYPES)):
        if col in have:
            rules.append((col, "enum", ~F.col(col).isin(allowed)))
    if "tariff_name" in have:
        rules.append(("tariff_name", "length", F.length("tariff_name") > 255))
    return rules


def provider_rules(df: DataFrame) -> list[Rule]:
    """(field, rule, violated) for a supplier record."""
    have = set(df.columns)
    rules: list[Rule] = [("name", "length", F.col("name").isNull() | ~F.length("name").between(1, 255))]
    for col, longest in (("url", 1024), ("skz_url", 1024), ("address", 255), ("zip", 10), ("city", 255), ("file_number", 20)):
        if col in have:
            rules.append((col, "length", F.length(col) > longest))
    for col in ("url", "skz_url"):
        if col in have:
            rules.append((col, "url", ~F.col(col).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$")))
    if "priority" in have:
        rules.append(("priority", "range", _outside("priority", 1, 100)))
    if "review_status" in have:
        rules.append(("review_status", "enum", ~F.col("review_status").isin(C.REVIEW_STATUSES)))
    return rules


def note_rules(df: DataFrame) -> list[Rule]:
    return [("text", "length", F.col("text").isNull() | ~F.length("text").between(1, 5000))]


def origin_rules(df: DataFrame) -> list[Rule]:
    return [
        ("country", "length", F.col("country").isNull() | ~F.length("country").between(1, 100)),
        ("percentage", "range", F.col("percentage").isNull() | _outside("percentage", 0, 100)),
    ]


def with_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    found = F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
        for field, rule, broken in rules
    ])
    return settle(df, {"violations": F.filter(found, lambda x: x.isNotNull())})


def violation_rows(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    return with_violations(df, rules).select(key, F.explode("violations").alias("v")).select(key, "v.field", "v.rule")


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected records."""
    checked = with_violations(df, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


# --- source guard and job outcome ------------------------------------------------------------------


def guard_sources(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """Adds ``source_unverified``: a foreign source that nobody confirmed.  Needs ``source_url``,
    ``provider_id`` and ``provider_name``."""
    flagged = trusted_flag(rows, trusted)
    foreign = F.coalesce(~source_matches(F.col("source_url"), F.col("provider_name")), F.lit(False))
    flagged = settle(flagged, {"source_unverified": foreign & ~F.col("trusted")})
    return flagged.withColumn("source_status", F.when(F.col("source_unverified"), F.lit("unbestaetigt"))).drop("trusted")


def job_outcome(year: Column, has_document: Column, unverified: Column) -> Column:
    """success needs an extracted year from a verified source; a stored document alone is partial."""
    return (
        F.when(year.isNotNull(), F.when(unverified, "partial").otherwise("success"))
        .when(has_document, "partial")
        .otherwise("failed")
    )
