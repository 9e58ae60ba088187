from pyspark.sql import functions as F

from labelspark import constants as C
from labelspark.sources import ledger, manifest, sinks, tables, tokens

CSV = """
anbieter_name,berichtsjahr,strommenge_mwh,hkn_land,hkn_menge_mwh
AggerEnergie,2024,5000,Norwegen,3600
  AGGERENERGIE GmbH ,2024,5500.5,  Schweden,100,extra

Unbekannt,2024,1,Norwegen,1
AggerEnergie,2024,,Norwegen,3
AggerEnergie,zwanzig,1,Norwegen,3
AggerEnergie,2024,5600 MWh,Norwegen,3700
"""


def test_ledger_import_from_file(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text(CSV, encoding="utf-8")
    lines = ledger.read_lines(spark, str(tmp_path))
    providers = spark.createDataFrame([(7, "AggerEnergie AG"), (3, "Agger-Energie GmbH"), (9, "Andere")], "id long, name string")
    deliveries = spark.createDataFrame([(3, 2023, "1.00"), (3, 2024, "2.00")], "provider_id long, year int, v string").select(
        "provider_id", "year", F.col("v").cast("decimal(15,2)").alias("delivered_volume_mwh"))
    cancelled = spark.createDataFrame([(3, 2024, "Norwegen", "5")], "provider_id long, year int, country string, v string").select(
        "provider_id", "year", "country", F.col("v").cast("decimal(15,2)").alias("amount_mwh"))
    out = ledger.import_ledger(lines, providers, deliveries, cancelled)
    # the smallest id wins for a shared key, the last line wins for a repeated key
    assert sorted((r[0], r[1], float(r[2])) for r in out["delivery"].collect()) == [(3, 2023, 1.0), (3, 2024, 5600.0)]
    assert sorted((r.country, float(r.amount_mwh)) for r in out["cancellation"].collect()) == [("Norwegen", 3700.0), ("Schweden", 100.0)]
    assert [r.message for r in out["unmatched"].collect()] == ['Anbieter nicht gefunden: "Unbekannt"']
    assert sorted(r.reason for r in out["rejected"].collect()) == ["field", "number"]
    assert tuple(out["tally"].first()) == (3, 3)


def test_lines_are_read_and_matched_once(spark):
    """All results of the matching job read one table; blanks are cut off without patterns and the key is computed once."""
    from labelspark.plans import jobs
    lines = spark.createDataFrame([(1, 5, " \t Agger-Energie GmbH,2024,1,Norwegen,2 \x0b"), (1, 6, "Nein,2024,1,Norwegen,2"), (1, 7, "Nein,2024,,,"), (1, 8, "\f ")],
                                  "ledger_id long, line_no long, line string")
    filled = ledger._filled(lines)
    assert [r.line[:5] for r in filled.orderBy("line_no").collect()] == ["Agger", "Nein,", "Nein,"] and "regexp" not in plan_of(filled)
    providers = spark.createDataFrame([(3, "AggerEnergie AG")], "id long, name string")
    documents = spark.createDataFrame([], "id long, provider_id long, file_type string, source_url string")
    mixes = spark.createDataFrame([], "document_id long, extraction_method string")
    out = jobs.supplier_matching(filled, documents, providers, mixes)
    assert [out[n].count() for n in ("matched", "unmatched", "rejected", "foreign")] == [1, 1, 1, 0]
    assert all("regexp" not in plan_of(out[n]) for n in ("matched", "unmatched", "rejected"))
    from labelspark.operators.joins import match_ledger
    hits = match_ledger(ledger.parse(filled)[0], providers).filter("provider_id is not null")
    assert plan_of(hits).count("regexp_replace(regexp_replace(lower(anbieter_name") == 1


def test_ledgers_are_written_as_several_files(spark):
    """No task has to sort a whole ledger."""
    from labelspark.plans import catalog, compliance
    from labelspark.plans.views import Views
    v = Views(spark, "/root/testdata/sf0.001")
    files = catalog.PLANS["s2_ledger_files"](v).inputFiles()
    ledgers = v.delivery.select("year").distinct().count()
    assert len(files) == ledgers * compliance.LEDGER_FILES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_files_larger_than_a_split(spark, tmp_path):
    """Headers go where files start, whatever tasks read the rest; blank lines may stand before them."""
    rows = [f"A{i},{2000 + i % 20},{i},Norwegen,{i}.5" for i in range(3000)]
    header = "anbieter_name,berichtsjahr,strommenge_mwh,hkn_land,hkn_menge_mwh"
    (tmp_path / "one.csv").write_text("\n  \r\n\t\n" + "\r\n".join([header, *rows]), encoding="utf-8")
    (tmp_path / "two.csv").write_text("\ufeff" + header + "\n\n" + "\n \n".join(rows[:10]) + "\n", encoding="utf-8")
    (tmp_path / "three.csv").write_text(header, encoding="utf-8")
    (tmp_path / "four.csv").write_text("\n\n", encoding="utf-8")
    (tmp_path / "five.csv").write_text(header + "\n" + header + '\n"quoted, 1",2,3,4,5\n' + "x" * 200_000 + ",2000,1,b,1\n\\,2000,1,\",1", encoding="utf-8")
    for name, value in (("spark.sql.files.maxPartitionBytes", "8k"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(name, value)
    try:
        lines = ledger.read_lines(spark, str(tmp_path))
        got = [(r.ledger_id.rsplit("/", 1)[1], r.line) for r in lines.orderBy("ledger_id", "line_no").collect()]
        assert lines.rdd.getNumPartitions() > 10 and "Exchange" not in plan_of(lines) and "Exchange" not in plan_of(ledger.parse(lines)[0])
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    assert got == ([("five.csv", line) for line in (header, '"quoted, 1",2,3,4,5', "x" * 200_000 + ",2000,1,b,1", '\\,2000,1,",1')]
                   + [("one.csv", r) for r in rows] + [("two.csv", r) for r in rows[:10]])


def test_ledger_lines_in_a_table(spark):
    rows = [(1, 5, "kopf"), (1, 6, " a "), (1, 4, "  "), (2, 1, "kopf"), (2, 2, "kopf"), (3, 1, "kopf")]
    lines = spark.createDataFrame(rows, "ledger_id long, line_no long, line string")
    assert sorted(map(tuple, ledger.data_lines(lines).collect())) == [(1, 6, "a"), (2, 2, "kopf")]
    # the headers' size is known, so the lines are not shuffled
    assert "BroadcastHashJoin" in plan_of(ledger.data_lines(lines)) and "hashpartitioning" not in plan_of(ledger.data_lines(lines))


def test_tables_stored_by_key(spark, tmp_path):
    from labelspark.operators import latest, merge

    providers = spark.range(40).select("id", F.concat(F.lit("n"), "id").alias("name"))
    jobs = spark.range(400).select("id", (F.col("id") * 7 % 45).alias("provider_id"), F.lit("success").alias("status"), F.lit("x").alias("log_message"))
    mixes = spark.range(300).select(
        "id", (F.col("id") * 3 % 45).alias("provider_id"), (F.col("id") * 11 % 90).alias("document_id"), F.lit(2020).alias("year"), F.lit("unbestaetigt").alias("source_status"),
        *[F.lit(1.0).alias(c) for c in latest.MIX_COLUMNS if c != "year"])
    documents = spark.range(90).select("id", (F.col("id") % 40).alias("provider_id"), F.lit(None).cast("int").alias("reporting_year"))
    tables_ = {"provider": providers, "job": jobs, "mix": mixes, "document_by_id": documents, "mix_by_document": mixes}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = {n: tables.store(df, n, str(tmp_path), 4) for n, df in tables_.items()}

        def overview(t):
            parts = [latest.latest_jobs(t["job"]), latest.latest_mixes(t["mix"])]
            out = t["provider"]
            for part in parts:
                out = out.join(part.withColumnRenamed("provider_id", "id"), "id", "left")
            return out

        for plan in (lambda t: latest.latest_jobs(t["job"]), overview, lambda t: merge.backfill_year(t["document_by_id"], t["mix_by_document"])):
            got = plan(stored)
            assert "Exchange" not in plan_of(got) and "Exchange" in plan_of(plan(tables_))
            assert sorted(map(str, got.collect())) == sorted(map(str, plan(tables_).select(got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in tables_:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b").write_bytes(b"\x89PNG....")
    (tmp_path / "c").write_bytes(b"\xff\xd8\xff..")
    (tmp_path / "d").write_bytes(b"<html>")
    files = manifest.read_files(spark, str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("prefix"), F.lit("Süd AG").alias("provider_name"), "content")
    got = {r.prefix: r for r in manifest.manifest(files, F.lit(2024)).collect()}
    assert [got[k].file_type for k in "abcd"] == ["pdf", "image", "image", "html"]
    assert [got[k].file_name.rsplit(".", 1)[1] for k in "abcd"] == ["pdf", "png", "jpg", "html"]
    assert got["a"].file_path == f"data/storage/sued-ag/2024/a_pdf_{got['a'].file_hash[:8]}.pdf" and got["a"].accepted
    big = spark.range(1).select(F.lit("x").alias("prefix"), F.lit("y").alias("provider_name"),
                                F.repeat(F.lit("x"), C.MAX_FILE_BYTES + 1).cast("binary").alias("content"))
    assert not manifest.manifest(big, F.lit(2024)).first().accepted


def test_printed_list(spark):
    rows = [(1, 4.0, 10.04, 1, " Stadtwerk A "), (1, 5.0, 10.0, 2, "zweiter"), (1, 25.0, 9.96, 3, "Weg 1"), (1, 39.5, 10.0, 4, "Ort"),
            (1, 3.0, 11.0, 5, "auf der Grenze"), (1, 4.0, 12.0, 6, "AB"), (1, 4.0, 13.0, 7, "Liste der Versorger"), (2, 4.0, 10.0, 8, "Stadtwerk B")]
    df = spark.createDataFrame(rows, "page int, x double, y double, seq int, text string")
    got = sorted((r.page, r.name, r.address, r.zip, r.city) for r in tokens.suppliers(df).collect())
    assert got == [(1, "Stadtwerk A", "Weg 1", None, "Ort"), (2, "Stadtwerk B", None, None, None)]


SNAPSHOT = ("id int, name string, city string, zip string, file_number string, priority int, active boolean, last_mix_year int, "
            "last_renewable_percentage double, last_fossil_percentage double, last_nuclear_percentage double, co2_emission_g_kwh double, "
            "last_confidence int, last_extraction_method string, latest_job_status string, review_status string, document_count int")


def snapshot(spark):
    df = spark.createDataFrame([
        (1, "Test-Versorger", "Leipzig", "04109", "123/456", 80, True, 2024, 60.5, 39.5, 0.0, 350.0, 95, "gemini", "success", "geprueft", 2),
        (2, '=SUM("x")', None, None, None, None, False, None, None, None, None, None, None, None, None, None, None),
    ], SNAPSHOT)
    return df.withColumns({c: F.col(c).cast("decimal(6,2)") for c in df.columns if c.endswith("percentage") or c.startswith("co2")})


def test_csv_and_json_sinks(spark, tmp_path):
    df = snapshot(spark)
    sinks.write_csv(df, str(tmp_path / "csv"))
    parts = sorted(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()
    assert lines[0] == "﻿" + ";".join(C.CSV_HEADER) and lines[0].count(";") == 16
    # a missing priority sorts first
    assert lines[1] == '2;"\'=SUM(""x"")";"";;;50;Nein;;;;;;;;Nie gescrapt;Offen;0'
    assert lines[2] == '1;"Test-Versorger";"Leipzig";04109;123/456;80;Ja;2024;60.5;39.5;0;350;95;gemini;Erfolgreich;Geprüft;2'
    sinks.write_json(df.select("id", "name"), str(tmp_path / "json"))
    assert spark.read.schema("id int, name string").json(str(tmp_path / "json")).count() == 2


def test_report(spark):
    figures, detail = sinks.report(snapshot(spark))
    assert tuple(figures.first()) == (2, 30)
    assert tuple(figures.sparkSession.createDataFrame([], SNAPSHOT).transform(sinks.mean_renewable).first()) == (0, 0)
    assert [tuple(r) for r in detail.orderBy("id").collect()] == [
        (1, "Test-Versorger", "Leipzig", "2024", "60.5%", "350 g/kWh", "Geprüft"), (2, '=SUM("x")', "-", "-", "0%", "- g/kWh", "Offen")]


def test_tables_round_trip(spark, tmp_path):
    for name, schema in tables.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path), name).count() == 0
    got = tables.adhoc(spark, {"t": spark.range(3)}, "SELECT sum(id) AS s FROM {t}")
    assert got.first().s == 3
