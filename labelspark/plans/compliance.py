"""Registered queries: ledger import, reconciliation, plausibility and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark.operators import compliance, filters, latest, paging, quality
from labelspark.operators.joins import match_ledger
from labelspark.plans.registry import query
from labelspark.plans.relational import num
from labelspark.plans.views import Views
from labelspark.sources import ledger
from labelspark.stage import Stages

RECON_COLUMNS = ["provider_id", "provider_name", "file_number", "document_id", "mix_id", "hkn", "volume", "soll_mwh", "ist_mwh",
                 "difference_mwh", "deviation_percent", "mix_point_diff", "audit_status"]
# exact decimals are shown as floats of six digits
RECON_SQL = ("provider_id, provider_name, file_number, document_id, mix_id, CAST(hkn AS DOUBLE) AS hkn, CAST(volume AS DOUBLE) AS volume, round(soll_mwh, 6) AS soll_mwh, "
             "CAST(ist_mwh AS DOUBLE) AS ist_mwh, round(difference_mwh, 6) AS difference_mwh, deviation_percent, mix_point_diff, audit_status")


LEDGER_FILES = 16  # of each ledger


def reconciled(v: Views) -> DataFrame:
    return compliance.reconciliation(v.provider, v.delivery, v.doc, v.mix, v.audit, v.cancellation, 2021)


def recon_columns(df: DataFrame) -> DataFrame:
    named = df.withColumnsRenamed({"hkn_percentage": "hkn", "delivered_volume_mwh": "volume"})
    numbers = ("hkn", "volume", "ist_mwh", "deviation_percent", "mix_point_diff")
    return named.withColumns({c: F.col(c).cast("double") for c in numbers} | {
        c: F.round(F.col(c).cast("double"), 6) for c in ("soll_mwh", "difference_mwh")}).select(RECON_COLUMNS)


def moved_year() -> Column:
    return F.when(F.col("year") == 2021, 1921).otherwise(F.col("year"))


def mixes(v: Views) -> DataFrame:
    return quality.short_names(v.mix)


# --- ledger -----------------------------------------------------------------------------------------


@query("s2_ledger_lines", """SELECT ledger_id, line_no, f[1] AS anbieter_name, CAST(f[2] AS INT) AS year,
  CAST(f[3] AS DOUBLE) AS delivered_volume_mwh, trim(f[4]) AS country, CAST(f[5] AS DOUBLE) AS amount_mwh
FROM v_ledger_row WHERE f[1] <> '' AND f[2] <> '' AND f[3] <> '' AND f[4] <> '' AND f[5] <> '' AND f[3] NOT IN ('1e30', 'viel')""")
def _(v: Views) -> DataFrame:
    good, _ = ledger.parse(v.ledger_data)
    return good.withColumns({c: F.col(c).cast("double") for c in ("delivered_volume_mwh", "amount_mwh")})


@query("s2_ledger_rejects", """SELECT ledger_id, line_no, trim(line) AS line,
  CASE WHEN f[1] = '' OR f[2] = '' OR f[3] = '' OR f[4] = '' OR f[5] = '' THEN 'field' ELSE 'number' END AS reason FROM v_ledger_row
WHERE f[1] = '' OR f[2] = '' OR f[3] = '' OR f[4] = '' OR f[5] = '' OR f[3] IN ('1e30', 'viel')""")
def _(v: Views) -> DataFrame:
    return ledger.parse(v.ledger_data)[1]


@query("s2_ledger_files", """SELECT ledger_id, f[1] AS anbieter_name, CAST(f[2] AS INT) AS year,
  CAST(f[3] AS DOUBLE) AS delivered_volume_mwh, trim(f[4]) AS country, CAST(f[5] AS DOUBLE) AS amount_mwh
FROM v_ledger_row WHERE f[1] <> '' AND f[2] <> '' AND f[3] <> '' AND f[4] <> '' AND f[5] <> '' AND f[3] NOT IN ('1e30', 'viel')""")
def _(v: Views) -> DataFrame:
    # ledgers come in files, each with the header on top: no task sorts a whole ledger
    folder = Stages(v.spark).folder("ledgers")
    part = F.when(F.col("line_no") == 1, F.sequence(F.lit(0), F.lit(LEDGER_FILES - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("line_no"), F.lit(LEDGER_FILES)).cast("int")))
    lines = v.ledger.withColumn("part", F.explode(part)).repartition("ledger_id", "part").sortWithinPartitions("ledger_id", "part", "line_no")
    lines.select("ledger_id", "part", F.col("line").alias("value")).write.mode("overwrite").partitionBy("ledger_id", "part").text(folder)
    good, _ = ledger.parse(ledger.read_lines(v.spark, folder))
    number = F.regexp_extract("ledger_id", r"ledger_id=([0-9]+)/", 1).cast("int").alias("ledger_id")
    return good.select(number, "anbieter_name", "year", num("delivered_volume_mwh"), "country", num("amount_mwh"))


@query("j11_ledger_match", """SELECT ledger_id, line_no, f[1] AS anbieter_name, provider_id FROM v_ledger_match""")
def _(v: Views) -> DataFrame:
    good, _ = ledger.parse(v.ledger_data)
    return match_ledger(good, v.provider).select("ledger_id", "line_no", "anbieter_name", "provider_id")


@query("w5_last_writer", """SELECT provider_id, year, delivered_volume_mwh FROM (
  SELECT provider_id, ledger_id AS year, CAST(f[3] AS DOUBLE) AS delivered_volume_mwh, line_no FROM v_ledger_match WHERE provider_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY provider_id, year ORDER BY line_no DESC) = 1""")
def _(v: Views) -> DataFrame:
    good, _ = ledger.parse(v.ledger_data)
    rows = match_ledger(good, v.provider).filter(F.col("provider_id").isNotNull())
    return latest.last_writer(rows.select("provider_id", "year", "delivered_volume_mwh", "line_no"), ["provider_id", "year"], "line_no").select(
        "provider_id", "year", num("delivered_volume_mwh"))


@query("a9_import_tally", """SELECT (SELECT count(*) FROM v_ledger_match WHERE provider_id IS NOT NULL) AS imported,
  (SELECT count(*) FROM v_ledger_row) - (SELECT count(*) FROM v_ledger_match WHERE provider_id IS NOT NULL) AS failed""")
def _(v: Views) -> DataFrame:
    return ledger.import_ledger(v.ledger_data, v.provider, v.delivery, v.cancellation)["tally"]


@query("a9_import_unmatched", """SELECT f[1] AS anbieter_name, count(*) AS lines, 'Anbieter nicht gefunden: "' || f[1] || '"' AS message
FROM v_ledger_match WHERE provider_id IS NULL GROUP BY f[1]""")
def _(v: Views) -> DataFrame:
    return ledger.import_ledger(v.ledger_data, v.provider, v.delivery, v.cancellation)["unmatched"]


@query("m1_upsert_deliveries", """WITH u AS (SELECT provider_id, ledger_id AS year, CAST(f[3] AS DOUBLE) AS vol FROM v_ledger_match WHERE provider_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY provider_id, ledger_id ORDER BY line_no DESC) = 1),
b AS (SELECT provider_id, CASE WHEN year = 2021 THEN 1921 ELSE year END AS year, CAST(delivered_volume_mwh AS DOUBLE) AS vol FROM v_delivery)
SELECT coalesce(b.provider_id, u.provider_id) AS provider_id, coalesce(b.year, u.year) AS year, coalesce(u.vol, b.vol) AS delivered_volume_mwh
FROM b FULL JOIN u ON u.provider_id = b.provider_id AND u.year = b.year""")
def _(v: Views) -> DataFrame:
    # one year is stored under another, so the merge both inserts and replaces
    base = v.delivery.withColumn("year", moved_year())
    return ledger.import_ledger(v.ledger_data, v.provider, base, v.cancellation)["delivery"].select(
        "provider_id", "year", num("delivered_volume_mwh"))


@query("m1_upsert_cancellations", """WITH u AS (SELECT provider_id, ledger_id AS year, trim(f[4]) AS country, CAST(f[5] AS DOUBLE) AS amount FROM v_ledger_match WHERE provider_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY provider_id, ledger_id, trim(f[4]) ORDER BY line_no DESC) = 1),
b AS (SELECT provider_id, CASE WHEN year = 2021 THEN 1921 ELSE year END AS year, country, CAST(amount_mwh AS DOUBLE) AS amount FROM v_cancellation)
SELECT coalesce(b.provider_id, u.provider_id) AS provider_id, coalesce(b.year, u.year) AS year, coalesce(b.country, u.country) AS country, coalesce(u.amount, b.amount) AS amount_mwh
FROM b FULL JOIN u ON u.provider_id = b.provider_id AND u.year = b.year AND u.country = b.country""")
def _(v: Views) -> DataFrame:
    base = v.cancellation.withColumn("year", moved_year())
    return ledger.import_ledger(v.ledger_data, v.provider, v.delivery, base)["cancellation"].select(
        "provider_id", "year", "country", num("amount_mwh"))


# --- reconciliation ---------------------------------------------------------------------------------


# every sixth supplier was to cancel nothing; others eight hundred, so that deviations end at half a hundredth of a percent
@query("q1_deviation", """SELECT provider_id, year, CAST(i - s AS DOUBLE) / 100 AS difference_mwh,
  CASE WHEN s = 0 THEN 0.0 ELSE CAST(sign(i - s) * ((2 * abs(i - s) * 10000 + s) // (2 * s)) AS DOUBLE) / 100 END AS deviation_percent
FROM (SELECT d.provider_id, d.year, CASE d.provider_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 80000 ELSE CAST(d.delivered_volume_mwh * 100 AS HUGEINT) END AS s,
  CASE WHEN d.provider_id % 6 = 1 THEN 80000 + (d.provider_id % 1000 - 500) * 2 ELSE CAST(c.total * 100 AS HUGEINT) END AS i
  FROM v_delivery d JOIN (SELECT provider_id, year, sum(amount_mwh) AS total FROM v_cancellation GROUP BY 1, 2) c ON c.provider_id = d.provider_id AND c.year = d.year)""")
def _(v: Views) -> DataFrame:
    key = F.col("provider_id")
    totals = v.cancellation.groupBy("provider_id", "year").agg(F.sum("amount_mwh").alias("ist"))
    soll = F.when(key % 6 == 0, F.lit(0).cast("decimal(15,2)")).when(key % 6 == 1, F.lit(800).cast("decimal(15,2)")).otherwise(F.col("delivered_volume_mwh"))
    near = (F.lit(800) + (key % 1000 - 500) * F.lit("0.02").cast("decimal(3,2)")).cast("decimal(25,2)")
    rows = v.delivery.join(totals, ["provider_id", "year"]).withColumn("soll", soll).withColumn("ist", F.when(key % 6 == 1, near).otherwise(F.col("ist")))
    return rows.select("provider_id", "year", compliance.difference(F.col("soll"), F.col("ist")).cast("double").alias("difference_mwh"),
                       compliance.deviation_percent(F.col("soll"), F.col("ist")).cast("double").alias("deviation_percent"))


@query("q14_country_comparison", """WITH d AS (SELECT o_custkey AS provider_id, CAST(year(o_orderdate) + 24 AS INT) AS year,
    CASE WHEN l_linenumber % 2 = 0 THEN ' ' || lower(n_name) ELSE n_name END AS country, CAST(l_quantity * 100 AS HUGEINT) AS v
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = l_partkey % 25 WHERE l_linestatus = 'O'),
e AS (SELECT 1 AS side, * FROM d UNION ALL SELECT 2, provider_id, year, country, CAST(amount_mwh * 100 AS HUGEINT) FROM v_cancellation),
g AS (SELECT side, provider_id, year, lower(trim(country)) AS k, min(trim(country)) AS shown, sum(v) AS v FROM e GROUP BY ALL),
t AS (SELECT *, sum(v) OVER (PARTITION BY side, provider_id, year) AS whole FROM g),
p AS (SELECT *, CAST((2 * v * 10000 + whole) // (2 * whole) AS DOUBLE) / 100 AS pct FROM t)
SELECT coalesce(a.provider_id, b.provider_id) AS provider_id, coalesce(a.year, b.year) AS year, least(a.shown, b.shown) AS country, a.pct AS declared_percent, b.pct AS cancelled_percent,
  round(coalesce(b.pct, 0) - coalesce(a.pct, 0), 2) AS points_apart
FROM (SELECT * FROM p WHERE side = 1) a FULL JOIN (SELECT * FROM p WHERE side = 2) b ON b.provider_id = a.provider_id AND b.year = a.year AND b.k = a.k""")
def _(v: Views) -> DataFrame:
    items = v.table("lineitem").filter("l_linestatus = 'O'").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(v.table("nation"), F.col("n_nationkey") == F.col("l_partkey") % 25)
    country = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name"))
    declared = items.select(F.col("o_custkey").alias("provider_id"), (F.year("o_orderdate") + 24).cast("int").alias("year"), country.alias("country"),
                            F.col("l_quantity").cast("decimal(5,2)").alias("percentage"))
    found = compliance.country_comparison(declared, v.cancellation)
    return found.withColumns({c: F.col(c).cast("double") for c in ("declared_percent", "cancelled_percent", "points_apart")})


@query("q2_reconciliation", f"SELECT {RECON_SQL} FROM v_recon")
def _(v: Views) -> DataFrame:
    return recon_columns(reconciled(v))


@query("q3_direction", """SELECT provider_id, mix_id, CASE WHEN difference_mwh < 0 THEN 'under' WHEN difference_mwh > 0 THEN 'over' ELSE 'balanced' END AS direction FROM v_recon""")
def _(v: Views) -> DataFrame:
    return reconciled(v).select("provider_id", "mix_id", compliance.direction(F.col("difference_mwh")).alias("direction"))


@query("f8_reconciliation_filter", f"""SELECT 'under' AS filter, {RECON_SQL} FROM v_recon WHERE difference_mwh < 0 AND abs(deviation_percent) >= 10
UNION ALL SELECT 'over', {RECON_SQL} FROM v_recon WHERE difference_mwh > 0 AND audit_status = 'offen'
UNION ALL SELECT 'text', {RECON_SQL} FROM v_recon WHERE contains(lower(provider_name), 'kg') OR contains(lower(file_number), 'kg')""")
def _(v: Views) -> DataFrame:
    rows = reconciled(v)
    found = {"under": filters.reconciliation(rows, direction="under", threshold=10.0),
             "over": filters.reconciliation(rows, direction="over", status="offen"), "text": filters.reconciliation(rows, text="KG")}
    return paging.union_all([recon_columns(df).withColumn("filter", F.lit(n)) for n, df in found.items()])


# Patterns, words, labels and messages inside the oracle statements below.
# --- plausibility -----------------------------------------------------------------------------------

EXPECTED_SQL = """SELECT id, year, ee, fo, nu, co2, wind, coal, floor((
    CASE WHEN wind > 0 AND ee > 0 THEN wind * least(1.0::DOUBLE, ee / nullif(wind, 0)) * 12 ELSE 0.0::DOUBLE END + CASE WHEN wind > 0 AND ee > 0 THEN 0.0::DOUBLE ELSE ee * 50 END
    + CASE WHEN coal > 0 AND fo > 0 THEN coal * least(1.0::DOUBLE, fo / nullif(coal, 0)) * 1000 ELSE 0.0::DOUBLE END + CASE WHEN coal > 0 AND fo > 0 THEN 0.0::DOUBLE ELSE fo * 700 END
    + nu * 12) / 100 * 10 + 0.5) / 10 AS expected_co2
  FROM (SELECT id, year, CAST(renewable_percentage AS DOUBLE) AS ee, CAST(fossil_percentage AS DOUBLE) AS fo, CAST(nuclear_percentage AS DOUBLE) AS nu,
    CAST(wind_percentage AS DOUBLE) AS wind, CAST(coal_percentage AS DOUBLE) AS coal, CAST(co2_emission_g_kwh AS DOUBLE) AS co2 FROM v_mix)"""

ISSUES_SQL = f"""e AS ({EXPECTED_SQL}),
k AS (SELECT *, floor(abs(floor((ee + fo + nu) * 100 + 0.5) / 100 - 100) * 100 + 0.5) / 100 AS dev FROM e),
issue AS (SELECT id, 'SUM_DEVIATION_ERROR' AS code, 'renewable,fossil,nuclear' AS path, 'error' AS severity FROM k WHERE dev > 2.0
UNION ALL SELECT id, 'SUM_DEVIATION_MINOR', 'renewable,fossil,nuclear', 'warning' FROM k WHERE dev > 0.5 AND dev <= 2.0
UNION ALL SELECT id, 'EE_SUBCATEGORIES_EXCEED_PARENT', 'renewable', 'error' FROM k WHERE wind > ee + 0.5
UNION ALL SELECT id, 'FOSSIL_SUBCATEGORIES_EXCEED_PARENT', 'fossil', 'error' FROM k WHERE coal > fo + 0.5
UNION ALL SELECT id, 'CO2_OUTSIDE_CORRIDOR', 'co2', 'warning' FROM k WHERE co2 > 0 AND floor(abs(co2 - expected_co2) * 10 + 0.5) / 10 > greatest(60.0::DOUBLE, expected_co2 * 0.35::DOUBLE)
UNION ALL SELECT id, 'NUCLEAR_AFTER_PHASEOUT', 'nuclear', 'warning' FROM k WHERE nu > 0.5 AND year >= 2023)"""


@query("q4_expected_co2", f"SELECT id, expected_co2 FROM ({EXPECTED_SQL})")
def _(v: Views) -> DataFrame:
    rows = mixes(v)
    return rows.select("id", quality.expected_co2(rows).alias("expected_co2"))


@query("q5_issues", f"WITH {ISSUES_SQL} SELECT * FROM issue")
def _(v: Views) -> DataFrame:
    return quality.issue_rows(mixes(v)).drop("message")


_SHOWN = "rtrim(rtrim(CAST(CAST({0} AS DECIMAL(20,2)) AS STRING), '0'), '.')"


@query("q5_issue_messages", f"""WITH t AS (SELECT id, year, CAST(nuclear_percentage AS DOUBLE) AS nu, renewable_percentage + fossil_percentage + nuclear_percentage AS total FROM v_mix)
SELECT id, 'SUM_DEVIATION_ERROR' AS code, 'Hauptkategorien summieren sich auf ' || {_SHOWN.format("total")} || '% statt 100% (Abweichung ' || {_SHOWN.format("abs(total - 100)")} || '% > Toleranz 2%).' AS message FROM t WHERE abs(total - 100) > 2
UNION ALL SELECT id, 'SUM_DEVIATION_MINOR', 'Hauptkategorien ergeben ' || {_SHOWN.format("total")} || '% – leichte Abweichung von ' || {_SHOWN.format("abs(total - 100)")} || '%.' FROM t WHERE abs(total - 100) > 0.5 AND abs(total - 100) <= 2
UNION ALL SELECT id, 'NUCLEAR_AFTER_PHASEOUT', 'Kernenergie-Anteil von ' || {_SHOWN.format("nu")} || '% im Jahr ' || CAST(year AS STRING) || ' ist für Deutschland unplausibel (Atomausstieg April 2023).' FROM t WHERE nu > 0.5 AND year >= 2023""")
def _(v: Views) -> DataFrame:
    rows = quality.issue_rows(mixes(v)).select("id", "code", "message")
    return rows.filter(F.col("code").isin("SUM_DEVIATION_ERROR", "SUM_DEVIATION_MINOR", "NUCLEAR_AFTER_PHASEOUT"))


# The parts of v_mix are wind and coal.  Fixed values: the texts.
@query("q5_part_and_co2_messages", f"""WITH {ISSUES_SQL}, r AS (SELECT *, floor(wind * 100 + 0.5) / 100 AS parts_ee, floor(coal * 100 + 0.5) / 100 AS parts_fo,
  floor(greatest(60.0::DOUBLE, expected_co2 * 0.35::DOUBLE) + 0.5) AS width FROM k)
SELECT r.id, code, CASE code WHEN 'EE_SUBCATEGORIES_EXCEED_PARENT' THEN 'Summe der EE-Unterkategorien (' || {_SHOWN.format("parts_ee")} || '%) übersteigt Erneuerbare Energien gesamt (' || {_SHOWN.format("ee")} || '%).'
  WHEN 'FOSSIL_SUBCATEGORIES_EXCEED_PARENT' THEN 'Summe der Fossil-Unterkategorien (' || {_SHOWN.format("parts_fo")} || '%) übersteigt Fossile Energieträger gesamt (' || {_SHOWN.format("fo")} || '%).'
  ELSE 'CO₂-Intensität (' || {_SHOWN.format("co2")} || ' g/kWh) weicht vom Erwartungswert (' || {_SHOWN.format("expected_co2")} || ' g/kWh) ab (Korridor: ±' || {_SHOWN.format("width")} || ' g/kWh).' END AS message
FROM r JOIN issue ON issue.id = r.id WHERE code IN ('EE_SUBCATEGORIES_EXCEED_PARENT', 'FOSSIL_SUBCATEGORIES_EXCEED_PARENT', 'CO2_OUTSIDE_CORRIDOR')""")
def _(v: Views) -> DataFrame:
    rows = quality.issue_rows(mixes(v)).select("id", "code", "message")
    return rows.filter(F.col("code").isin("EE_SUBCATEGORIES_EXCEED_PARENT", "FOSSIL_SUBCATEGORIES_EXCEED_PARENT", "CO2_OUTSIDE_CORRIDOR"))


@query("q5_validity", f"""WITH {ISSUES_SQL} SELECT v_mix.id, n IS NULL OR errors = 0 AS is_valid, coalesce(n, 0) AS issues
FROM v_mix LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (severity = 'error') AS errors FROM issue GROUP BY id) i ON i.id = v_mix.id""")
def _(v: Views) -> DataFrame:
    return quality.with_issues(mixes(v)).select("id", "is_valid", F.size("issues").alias("issues"))


@query("q5_issue_counts", f"WITH {ISSUES_SQL} SELECT code, severity, count(*) AS mixes FROM issue GROUP BY code, severity")
def _(v: Views) -> DataFrame:
    return quality.issue_rows(mixes(v)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("mixes"))


@query("q6_ingest_gate", """SELECT id, NOT (s > 150) AS accepted, concat_ws(',', CASE WHEN same THEN 'identical' END, CASE WHEN off THEN 'sum' END, CASE WHEN late THEN 'nuclear' END, CASE WHEN big THEN 'over_100' END) AS warnings,
  least(confidence, CASE WHEN same THEN 10 ELSE 100 END, CASE WHEN off THEN 20 ELSE 100 END, CASE WHEN late THEN 30 ELSE 100 END, CASE WHEN big THEN 5 ELSE 100 END) AS confidence
FROM (SELECT id, confidence, ee + fo + nu AS s, ee = fo AND fo = nu AND ee > 0 AS same, ee + fo + nu > 0 AND abs(ee + fo + nu - 100) > 5 AS off,
        nu > 5 AND year >= 2024 AS late, ee > 100 OR fo > 100 OR nu > 100 AS big
  FROM (SELECT id, confidence, CAST(year + id % 4 AS INT) AS year, CASE WHEN id % 10 = 0 THEN 33.0::DOUBLE WHEN id % 10 = 1 THEN 130.0 ELSE CAST(renewable_percentage AS DOUBLE) END AS ee,
          CASE WHEN id % 10 = 0 THEN 33.0::DOUBLE ELSE CAST(fossil_percentage AS DOUBLE) END AS fo, CASE WHEN id % 10 = 0 THEN 33.0::DOUBLE ELSE CAST(nuclear_percentage AS DOUBLE) END AS nu FROM v_mix))""")
def _(v: Views) -> DataFrame:
    # part of the mixes is bent, so that every rule of the gate fires
    key, rows = F.col("id"), mixes(v)
    bent = rows.withColumns({
        "year": (F.col("year") + key % 4).cast("int"),
        "renewable": F.when(key % 10 == 0, 33.0).when(key % 10 == 1, 130.0).otherwise(F.col("renewable")),
        "fossil": F.when(key % 10 == 0, 33.0).otherwise(F.col("fossil")),
        "nuclear": F.when(key % 10 == 0, 33.0).otherwise(F.col("nuclear")),
    })
    return quality.ingest_gate(bent).select("id", "accepted", F.array_join("gate_warnings", ",").alias("warnings"), "confidence")


@query("q7_confidence_penalty", f"""WITH {ISSUES_SQL} SELECT m.id, CASE WHEN EXISTS (SELECT 1 FROM issue i WHERE i.id = m.id AND severity = 'error') THEN greatest(0, c - 30) ELSE c END AS confidence
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 80 ELSE confidence END AS c FROM v_mix) m""")
def _(v: Views) -> DataFrame:
    checked = quality.with_issues(mixes(v))
    given = F.when(F.col("id") % 3 != 0, F.col("confidence"))
    return checked.select("id", quality.penalised_confidence(given, F.col("is_valid")).alias("confidence"))


@query("q8_national_comparison", """SELECT id, year, d1 AS renewable_diff, d2 AS fossil_diff, d3 AS nuclear_diff,
  CASE WHEN abs(r1) < 2 THEN 'neutral' WHEN r1 > 0 THEN 'above' ELSE 'below' END AS renewable_class,
  CASE WHEN abs(r2) < 2 THEN 'neutral' WHEN r2 > 0 THEN 'above' ELSE 'below' END AS fossil_class,
  CASE WHEN abs(r3) < 2 THEN 'neutral' WHEN r3 > 0 THEN 'above' ELSE 'below' END AS nuclear_class
FROM (SELECT *, floor(r1 * 10 + 0.5) / 10 AS d1, floor(r2 * 10 + 0.5) / 10 AS d2, floor(r3 * 10 + 0.5) / 10 AS d3 FROM (
  SELECT m.id, m.year, CAST(renewable_percentage AS DOUBLE) + CAST(m.id % 10 AS DOUBLE) / 100 - ee AS r1, CAST(fossil_percentage AS DOUBLE) - fossil AS r2, CAST(nuclear_percentage AS DOUBLE) - nuclear AS r3
  FROM v_mix m JOIN (VALUES (2020, 45.5::DOUBLE, 40.5::DOUBLE, 6.1::DOUBLE), (2021, 42.0, 44.3, 6.4), (2022, 44.1, 42.9, 6.4), (2023, 51.8, 39.5, 1.5)) b(year, ee, fossil, nuclear)
  ON b.year = CASE WHEN m.year BETWEEN 2020 AND 2023 THEN m.year ELSE 2023 END))""")
def _(v: Views) -> DataFrame:
    # hundredths bring some differences between the band of two points and its rounded form
    shifted = mixes(v).withColumn("renewable", F.col("renewable").cast("double") + (F.col("id") % 10).cast("double") / 100)
    return quality.compare_to_national(shifted).select(
        "id", "year", *[f"{s}_{k}" for s in ("renewable", "fossil", "nuclear") for k in ("diff", "class")])


@query("q9_mix_violations", """SELECT id, field, rule FROM (SELECT id, CAST(year + 1000 * (id % 2) AS INT) AS year, provider_id, document_id, renewable_percentage, CASE WHEN id % 7 = 0 THEN -1 ELSE fossil_percentage END AS fossil,
    CASE WHEN id % 5 = 0 THEN confidence + 50 ELSE confidence END AS confidence, extraction_method FROM v_mix),
  LATERAL (SELECT 'year' AS field, 'range' AS rule WHERE year < 2000 OR year > 2100 UNION ALL SELECT 'provider_id', 'positive' WHERE provider_id <= 0
    UNION ALL SELECT 'document_id', 'positive' WHERE document_id <= 0 UNION ALL SELECT 'renewable_percentage', 'range' WHERE renewable_percentage < 0 OR renewable_percentage > 100
    UNION ALL SELECT 'fossil_percentage', 'range' WHERE fossil < 0 OR fossil > 100 UNION ALL SELECT 'confidence', 'range' WHERE confidence > 100
    UNION ALL SELECT 'extraction_method', 'enum' WHERE extraction_method NOT IN ('gemini_vision', 'gemini_text', 'regex', 'manual', 'ocr'))""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    bent = v.mix.withColumns({
        "year": (F.col("year") + 1000 * (key % 2)).cast("int"),
        "fossil_percentage": F.when(key % 7 == 0, F.lit(-1)).otherwise(F.col("fossil_percentage")),
        "confidence": F.when(key % 5 == 0, F.col("confidence") + 50).otherwise(F.col("confidence")),
    })
    return quality.violation_rows(bent, quality.mix_rules(bent))


@query("q9_provider_violations", """SELECT id, field, rule FROM (SELECT id, repeat(name, CAST(CASE WHEN id % 13 = 0 THEN 20 ELSE 1 END AS BIGINT)) AS name, city || repeat('x', CAST(CASE WHEN id % 17 = 0 THEN 300 ELSE 0 END AS BIGINT)) AS city,
    file_number, priority + CASE WHEN id % 3 = 0 THEN 40 ELSE 0 END AS priority, CASE WHEN id % 8 = 0 THEN 'neu' ELSE review_status END AS review_status FROM v_provider),
  LATERAL (SELECT 'name' AS field, 'length' AS rule WHERE length(name) > 255 OR length(name) < 1 UNION ALL SELECT 'city', 'length' WHERE length(city) > 255
    UNION ALL SELECT 'file_number', 'length' WHERE length(file_number) > 20 UNION ALL SELECT 'priority', 'range' WHERE priority < 1 OR priority > 100
    UNION ALL SELECT 'review_status', 'enum' WHERE review_status NOT IN ('offen', 'geprueft', 'beanstandet'))""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    bent = v.provider.withColumns({
        "name": F.repeat("name", F.when(key % 13 == 0, 20).otherwise(1)),
        "city": F.concat("city", F.repeat(F.lit("x"), F.when(key % 17 == 0, 300).otherwise(0))),
        "priority": F.col("priority") + F.when(key % 3 == 0, 40).otherwise(0),
        "review_status": F.when(key % 8 == 0, "neu").otherwise(F.col("review_status")),
    })
    return quality.violation_rows(bent, quality.provider_rules(bent))


SOURCES_SQL = """SELECT d.id, d.provider_id, d.reporting_year, CASE WHEN len(w.words) = 0 THEN FALSE
    ELSE len(list_filter(w.words, lambda x: contains(lower(d.source_url), x))) = 0 AND t.domain IS NULL END AS source_unverified
FROM v_doc d JOIN v_words w ON w.id = d.provider_id LEFT JOIN v_trusted t ON t.provider_id = d.provider_id
  AND t.domain = regexp_replace(lower(regexp_extract(d.source_url, '^https?://([^/]+)', 1)), '^www\\.', '')"""


def guarded(v: Views) -> DataFrame:
    names = v.provider.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    return quality.guard_sources(v.doc.drop("text").join(names, "provider_id"), v.trusted)


@query("q10_source_guard", f"""SELECT id, provider_id, source_unverified, CASE WHEN source_unverified THEN 'unbestaetigt' END AS source_status FROM ({SOURCES_SQL})""")
def _(v: Views) -> DataFrame:
    return guarded(v).select("id", "provider_id", "source_unverified", "source_status")


@query("q11_job_outcome", f"""SELECT id, CASE WHEN id % 9 = 4 THEN 'failed' WHEN reporting_year IS NULL THEN 'partial' WHEN source_unverified THEN 'partial' ELSE 'success' END AS status FROM ({SOURCES_SQL})""")
def _(v: Views) -> DataFrame:
    lost = F.col("id") % 9 == 4  # jobs that brought nothing at all
    year = F.when(~lost, F.col("reporting_year"))
    return guarded(v).select("id", quality.job_outcome(year, ~lost, F.col("source_unverified")).alias("status"))
