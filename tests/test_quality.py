from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from labelspark.operators import compliance, joins, quality

PARTS = "solar double, wind double, hydro double, biomass double, other_renewable double, coal double, natural_gas double, other_fossil double"
SCHEMA = "id int, renewable double, fossil double, nuclear double, year int, co2 double, " + PARTS


def mix(i, ee, fo, nu, year=None, co2=None, **parts):
    names = [p.split()[0] for p in PARTS.split(", ")]
    return (i, float(ee), float(fo), float(nu), year, co2, *[None if p not in parts else float(parts[p]) for p in names])


def test_deviation(values):
    got = values(compliance.deviation_percent, [(4000.0, 3600.0), (0.0, 50.0)], "s double, i double")
    assert got == [-10.0, 0.0]
    assert values(compliance.difference, [(4000.0, 3600.0), (0.0, 50.0)], "s double, i double") == [-400.0, 50.0]


def test_expected_co2(spark):
    rows = [mix(1, 100, 0, 0, wind=100), mix(2, 50, 50, 0), mix(3, 40, 60, 0, wind=80, coal=30, natural_gas=30), mix(4, 0, 0, 100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.c for r in df.select("id", quality.expected_co2(df).alias("c")).collect()}
    # 3: wind is scaled from 80 to 40: (40*12 + 30*1000 + 30*480) / 100
    assert got == {1: 12.0, 2: 375.0, 3: 448.8, 4: 12.0}


def test_issues(spark):
    rows = [
        mix(1, 50, 40, 10, 2022, 350.0, wind=20, solar=15, biomass=15, natural_gas=40),
        mix(2, 60, 50, 10), mix(3, 50, 40.8, 10), mix(4, 40, 50, 10, solar=30, wind=20), mix(5, 60, 35, 5, 2023),
        mix(6, 50, 50, 0, co2=900.0), mix(7, 50, 50, 0, coal=60), mix(8, 50, 50, 0, co2=0.0),
    ]
    df = quality.with_issues(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: (r.is_valid, [i.code for i in r.issues]) for r in df.collect()}
    assert got == {
        1: (True, ["CO2_OUTSIDE_CORRIDOR"]), 2: (False, ["SUM_DEVIATION_ERROR"]), 3: (True, ["SUM_DEVIATION_MINOR"]),
        4: (False, ["EE_SUBCATEGORIES_EXCEED_PARENT"]), 5: (True, ["NUCLEAR_AFTER_PHASEOUT"]), 6: (True, ["CO2_OUTSIDE_CORRIDOR"]),
        7: (False, ["FOSSIL_SUBCATEGORIES_EXCEED_PARENT"]), 8: (True, []),
    }


def test_messages_of_parts_and_co2(spark):
    rows = [mix(1, 40, 50, 10, solar=30.25, wind=20), mix(2, 50, 50, 0, coal=60.5), mix(3, 50, 50, 0, co2=900.5), mix(4, 0, 0, 100, co2=80.0)]
    got = {r.id: r.message for r in quality.issue_rows(spark.createDataFrame(rows, SCHEMA)).collect() if not r.code.startswith("SUM")}
    assert got == {
        1: "Summe der EE-Unterkategorien (50.25%) übersteigt Erneuerbare Energien gesamt (40%).",
        2: "Summe der Fossil-Unterkategorien (60.5%) übersteigt Fossile Energieträger gesamt (50%).",
        3: "CO₂-Intensität (900.5 g/kWh) weicht vom Erwartungswert (375 g/kWh) ab (Korridor: ±131 g/kWh).",
        4: "CO₂-Intensität (80 g/kWh) weicht vom Erwartungswert (12 g/kWh) ab (Korridor: ±60 g/kWh).",
    }


def test_ingest_gate(spark):
    rows = [(1, 30.0, 30.0, 30.0, 2020, 90), (2, 50.0, 30.0, 10.0, 2020, 90), (3, 50.0, 40.0, 10.0, 2024, 90),
            (4, 120.0, 20.0, 20.0, 2020, 90), (5, 60.0, 40.0, None, 2024, 15), (6, 0.0, 0.0, 0.0, 2024, 50)]
    df = spark.createDataFrame(rows, "id int, renewable double, fossil double, nuclear double, year int, confidence int")
    got = {r.id: (r.confidence, r.accepted, r.gate_warnings) for r in quality.ingest_gate(df).collect()}
    assert got == {
        1: (10, True, ["identical", "sum"]), 2: (20, True, ["sum"]), 3: (30, True, ["nuclear"]),
        4: (5, False, ["sum", "over_100"]), 5: (15, True, []), 6: (50, True, []),
    }


def test_penalty_and_outcome(values):
    got = values(quality.penalised_confidence, [(None, True), (20, False), (95, False), (95, True)], "c int, v boolean")
    assert got == [80, 0, 65, 95]
    got = values(quality.job_outcome, [(2022, True, False), (2022, True, True), (None, True, False), (None, False, False)],
                 "y int, d boolean, u boolean")
    assert got == ["success", "partial", "partial", "failed"]


def test_split_valid(spark):
    rows = [(1, "A", 50, "offen", "https://x.de"), (2, "", 50, None, None), (3, "B", 101, "neu", "kein url")]
    df = spark.createDataFrame(rows, "id int, name string, priority int, review_status string, url string")
    good, bad = quality.split_valid(df, quality.provider_rules(df))
    assert [r.id for r in good.collect()] == [1]
    got = {r.id: sorted(v.field for v in r.violations) for r in bad.collect()}
    assert got == {2: ["name"], 3: ["priority", "review_status", "url"]}
    notes = spark.createDataFrame([(1, "x"), (2, ""), (3, "y" * 5001)], "id int, text string")
    assert [r.id for r in quality.violation_rows(notes, quality.note_rules(notes)).orderBy("id").collect()] == [2, 3]
    origins = spark.createDataFrame([(1, "Norwegen", 60.0), (2, "", 10.0), (3, "Island", 120.0)], "id int, country string, percentage double")
    assert [r.id for r in quality.violation_rows(origins, quality.origin_rules(origins)).orderBy("id").collect()] == [2, 3]


def test_national_mix_fallback(spark):
    df = spark.createDataFrame([(1, 2020), (2, 1999), (3, None)], "id int, year int")
    got = {r.id: r.national_renewable for r in joins.with_national_mix(df).collect()}
    assert got == {1: 45.5, 2: 51.8, 3: 51.8}


def test_reconciliation_fans_out_and_dedupes(spark):
    providers = spark.createDataFrame([(1, "A", None, True), (2, "B", "7", True), (3, "C", None, False)], "id long, name string, file_number string, active boolean")
    deliveries = spark.createDataFrame([(1, 2021, 1000), (1, 2020, 5)], "provider_id long, year int, delivered_volume_mwh int")
    docs = spark.createDataFrame([(10, 1, "pdf", 2021), (11, 1, "pdf", 2021), (12, 2, "image", 2021)], "id long, provider_id long, file_type string, reporting_year int")
    mixes = spark.createDataFrame([(100, 10, 40.0, 60.0), (101, 11, 50.0, 60.0)], "id long, document_id long, hkn_percentage double, renewable_percentage double")
    audits = spark.createDataFrame([(1, 2021, "plausibel")], "provider_id long, year int, status string")
    cancelled = spark.createDataFrame([(1, 2021, "NO", 300), (1, 2021, "SE", 60), (1, 2020, "NO", 9)], "provider_id long, year int, country string, amount_mwh int")
    args = (providers, deliveries, docs, mixes, audits, cancelled, 2021)
    got = sorted((r.provider_id, r.mix_id, r.soll_mwh, r.ist_mwh, r.deviation_percent, r.mix_point_diff, r.audit_status)
                 for r in compliance.reconciliation(*args).fillna(-1, ["mix_id"]).collect())
    assert got == [(1, 100, 400.0, 360.0, -10.0, -4.0, "plausibel"), (1, 101, 500.0, 360.0, -28.0, -14.0, "plausibel"),
                   (2, -1, 0.0, 0.0, 0.0, 0.0, "offen")]
    latest = compliance.reconciliation(*args, latest_only=True)
    assert sorted((r.provider_id, r.mix_id) for r in latest.fillna(-1, ["mix_id"]).collect()) == [(1, 101), (2, -1)]
    assert [r.d for r in latest.select(compliance.direction(F.col("difference_mwh")).alias("d")).orderBy("d").collect()] == ["balanced", "under"]


def test_deviations_are_exact(values):
    """Halves of a hundredth go away from zero, on both sides, and are not rounded twice."""
    rows = [("800", "800.04"), ("800", "799.96"), ("800", "800.039999"), ("800", "800.12"), ("0.000001", "9999999999999.99"), ("0", "5"), (None, "5"), ("3", None),
            ("99999999999.99", "0.01"), ("300", "300.015"), ("7", "7.00035"), ("7", "7.000349"), ("-800", "-800.04"), ("-800", "800")]
    got = values(lambda s, i: compliance.deviation_percent(s.cast("decimal(25,6)"), i.cast("decimal(25,6)")), rows, "s string, i string")
    want = []
    for soll, ist in rows:
        s, i = (Decimal(x or "0") for x in (soll, ist))
        exact = Fraction(i - s) / Fraction(s) * 10_000 if s else Fraction(0)
        want.append(Decimal(int(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)) / 100)
    assert got == want


def test_country_comparison(spark):
    declared = spark.createDataFrame([(1, 2021, "Norwegen", 60.0), (1, 2021, " norwegen", 20.0), (1, 2021, "Island", 20.0), (1, 2021, "", 9.0), (2, 2021, "Island", 5.0)],
                                     "provider_id long, year int, country string, percentage double")
    cancelled = spark.createDataFrame([(1, 2021, "Norwegen", 1.0), (1, 2021, "Schweden", 2.0), (3, 2020, "Island", 0.0)],
                                      "provider_id long, year int, country string, amount_mwh double")
    got = {(r[0], r[1], r[2]): tuple(None if x is None else float(x) for x in r[3:]) for r in compliance.country_comparison(declared, cancelled).collect()}
    assert got == {(1, 2021, "Norwegen"): (80.0, 33.33, -46.67), (1, 2021, "Island"): (20.0, None, -20.0), (1, 2021, "Schweden"): (None, 66.67, 66.67),
                   (2, 2021, "Island"): (100.0, None, -100.0), (3, 2020, "Island"): (None, None, 0.0)}
