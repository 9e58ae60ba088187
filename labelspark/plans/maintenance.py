"""Registered queries: keyed maintenance of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelspark.operators import merge
from labelspark.operators.aggregates import table_metrics
from labelspark.plans.registry import query
from labelspark.plans.relational import num
from labelspark.plans.views import Views

CHANGED_SQL = """SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE city END AS city,
  CASE WHEN id % 5 = 0 THEN '99 ' || CAST(id AS STRING) ELSE file_number END AS file_number, CAST(CASE WHEN id % 4 = 0 THEN 100 ELSE priority END AS INT) AS priority,
  CASE WHEN id % 7 = 0 THEN 'geprueft' ELSE review_status END AS review_status FROM v_provider"""


def changed_providers(v: Views) -> DataFrame:
    """A later snapshot of the suppliers with edits in five fields."""
    key = F.col("id")
    return v.provider.withColumns({
        "name": F.when(key % 2 == 0, F.upper("name")).otherwise(F.col("name")),
        "city": F.when(key % 3 != 0, F.col("city")),
        "file_number": F.when(key % 5 == 0, F.concat(F.lit("99 "), key.cast("string"))).otherwise(F.col("file_number")),
        "priority": F.when(key % 4 == 0, 100).otherwise(F.col("priority")),
        "review_status": F.when(key % 7 == 0, "geprueft").otherwise(F.col("review_status")),
    })


@query("m1_upsert_providers", """SELECT coalesce(p.id, n.id) AS id, coalesce(n.name, p.name) AS name, CASE WHEN n.id IS NULL THEN p.city ELSE n.city END AS city, p.priority
FROM v_provider p FULL JOIN (SELECT id + 3 AS id, name, city FROM v_provider WHERE name LIKE '%GmbH%') n ON n.id = p.id""")
def _(v: Views) -> DataFrame:
    updates = v.provider.filter(F.col("name").contains("GmbH")).select((F.col("id") + 3).alias("id"), "name", "city")
    return merge.upsert(v.provider.select("id", "name", "city", "priority"), updates, ["id"])


@query("m2_insert_if_absent", """SELECT * FROM v_trusted UNION
SELECT provider_id, regexp_replace(lower(regexp_extract(source_url, '^https?://([^/]+)', 1)), '^www\\.', '') FROM v_doc""")
def _(v: Views) -> DataFrame:
    from labelspark.functions.urls import domain
    new = v.doc.select("provider_id", domain(F.col("source_url")).alias("domain"))
    return merge.insert_if_absent(v.trusted, new, ["provider_id", "domain"])


@query("m3_replace_children", """WITH n AS (SELECT provider_id, year, CASE WHEN provider_id % 5 = 0 THEN '' ELSE ' ' || country END AS country, CASE WHEN provider_id % 7 = 0 THEN -1 ELSE amount_mwh * 2 END AS amount_mwh
  FROM (SELECT * REPLACE (CASE WHEN provider_id % 3 = 0 THEN year ELSE year + 100 END AS year) FROM v_cancellation))
SELECT provider_id, year, country, CAST(amount_mwh AS DOUBLE) AS amount_mwh FROM v_cancellation c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.provider_id = c.provider_id AND n.year = c.year)
UNION ALL SELECT provider_id, year, trim(country), CAST(amount_mwh AS DOUBLE) FROM n WHERE country <> '' AND amount_mwh > 0""")
def _(v: Views) -> DataFrame:
    key = F.col("provider_id")
    # a third of the suppliers are replaced, the others get new years
    year = F.when(key % 3 == 0, F.col("year")).otherwise(F.col("year") + 100).alias("year")
    new = v.cancellation.select(
        "provider_id", year, F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" "), "country")).alias("country"),
        F.when(key % 7 == 0, F.lit(-1)).otherwise(F.col("amount_mwh") * 2).alias("amount_mwh"))
    return merge.replace_children(v.cancellation, new, ["provider_id", "year"]).select("provider_id", "year", "country", num("amount_mwh"))


def tables(v: Views) -> dict[str, DataFrame]:
    origins = v.table("lineitem").select(F.col("l_orderkey").alias("energy_mix_id"), "l_suppkey")
    return {"provider": v.provider, "job": v.job, "document": v.doc.drop("text"), "mix": v.mix, "origin": origins,
            "delivery": v.delivery, "cancellation": v.cancellation, "audit": v.audit}


@query("m4_cascade_provider", """WITH gone AS (SELECT id FROM v_provider WHERE NOT active),
d AS (SELECT id FROM v_doc WHERE provider_id NOT IN (SELECT id FROM gone)),
m AS (SELECT id FROM v_mix WHERE provider_id NOT IN (SELECT id FROM gone) AND (document_id IS NULL OR document_id NOT IN (SELECT id FROM v_doc WHERE provider_id IN (SELECT id FROM gone))))
SELECT 'provider' AS metric, count(*) AS rows FROM v_provider WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'job', count(*) FROM v_job WHERE provider_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'document', count(*) FROM d
UNION ALL SELECT 'mix', count(*) FROM m UNION ALL SELECT 'origin', count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM m)
UNION ALL SELECT 'delivery', count(*) FROM v_delivery WHERE provider_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'cancellation', count(*) FROM v_cancellation WHERE provider_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'audit', count(*) FROM v_audit WHERE provider_id NOT IN (SELECT id FROM gone)""")
def _(v: Views) -> DataFrame:
    return table_metrics(merge.delete_providers(tables(v), v.provider.filter(~F.col("active")).select("id")))


@query("m4_cascade_document", """WITH gone AS (SELECT id FROM v_doc WHERE file_type = 'image')
SELECT 'document' AS metric, count(*) AS rows FROM v_doc WHERE file_type <> 'image'
UNION ALL SELECT 'mix', count(*) FROM v_mix WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'origin', count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM v_mix WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gone))""")
def _(v: Views) -> DataFrame:
    kept = merge.delete_documents(tables(v), v.doc.filter(F.col("file_type") == "image").select("id"))
    return table_metrics({n: kept[n] for n in ("document", "mix", "origin")})


@query("m5_abort_running", """SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' THEN coalesce(log_message, '') || ' | Abgebrochen (Batch-Start)' ELSE log_message END AS log_message,
  CASE WHEN status = 'running' THEN '2024-01-31 00:00:00' END AS finished_at FROM v_job""")
def _(v: Views) -> DataFrame:
    as_of = F.lit("2024-01-31 00:00:00")
    jobs = v.job.withColumn("finished_at", F.lit(None).cast("string"))
    return merge.abort_running(jobs, as_of).select("id", "status", "log_message", "finished_at")


@query("m6_backfill", """SELECT d.id, coalesce(d.provider_id, j.provider_id) AS provider_id, coalesce(d.reporting_year, y.year) AS reporting_year
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE provider_id END AS provider_id, id * 4 AS job_id, reporting_year FROM v_doc) d
LEFT JOIN v_job j ON j.id = d.job_id LEFT JOIN (SELECT document_id, arg_min(year, id) AS year FROM v_mix WHERE document_id IS NOT NULL GROUP BY 1) y ON y.document_id = d.id""")
def _(v: Views) -> DataFrame:
    docs = v.doc.select("id", F.when(F.col("id") % 3 != 0, F.col("provider_id")).alias("provider_id"),
                        (F.col("id") * 4).alias("job_id"), "reporting_year")
    filled = merge.backfill_provider(docs, v.job, "job_id")
    return merge.backfill_year(filled, v.mix).select("id", "provider_id", "reporting_year")


@query("m6_backfill_mix", """SELECT m.id, coalesce(CASE WHEN m.id % 4 = 0 THEN NULL ELSE m.provider_id END, d.provider_id) AS provider_id
FROM v_mix m LEFT JOIN v_doc d ON d.id = m.document_id""")
def _(v: Views) -> DataFrame:
    gaps = v.mix.withColumn("provider_id", F.when(F.col("id") % 4 != 0, F.col("provider_id")))
    return merge.backfill_provider(gaps, v.doc, "document_id").select("id", "provider_id")


@query("m7_deactivate", """SELECT id, active AND id NOT IN (SELECT provider_id FROM v_job WHERE status = 'running') AND id NOT IN (1, 2, 3) AS active FROM v_provider""")
def _(v: Views) -> DataFrame:
    stuck = v.job.filter(F.col("status") == "running").select(F.col("provider_id").alias("id"))
    return merge.deactivate(merge.deactivate(v.provider, stuck), [1, 2, 3]).select("id", "active")


@query("m8_change_audit", f"""WITH n AS ({CHANGED_SQL}),
c AS (SELECT o.id, f.field, f.old_value, f.new_value FROM v_provider o JOIN n ON n.id = o.id,
  LATERAL (SELECT 'Name' AS field, o.name AS old_value, n.name AS new_value UNION ALL SELECT 'Stadt', o.city, n.city UNION ALL SELECT 'Aktenzeichen', o.file_number, n.file_number
    UNION ALL SELECT 'Priorität', CAST(o.priority AS STRING), CAST(n.priority AS STRING) UNION ALL SELECT 'Prüfstatus', o.review_status, n.review_status) f WHERE f.old_value IS DISTINCT FROM f.new_value)
SELECT id AS entity_id, CASE field WHEN 'Prüfstatus' THEN 'review_change' ELSE 'update' END AS action, field, old_value, new_value,
  field || ' geändert: ' || coalesce(old_value, '-') || ' → ' || coalesce(new_value, '-') AS description FROM c""")
def _(v: Views) -> DataFrame:
    return merge.change_audit(v.provider, changed_providers(v)).drop("old_json", "new_json")


@query("m9_enrich", """SELECT p.id, CASE WHEN p.name IS NULL OR length(p.name) < 3 THEN coalesce(e.company_name, p.name) ELSE p.name END AS name, coalesce(nullif(e.company_city, ''), p.city) AS city
FROM (SELECT id, CASE WHEN id % 6 = 0 THEN 'AB' WHEN id % 6 = 1 THEN NULL ELSE name END AS name, city FROM v_provider) p
LEFT JOIN (SELECT CASE WHEN priority >= 70 THEN id ELSE -id END AS id, 'Firma ' || CAST(id AS STRING) AS company_name, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'Leipzig' END AS company_city FROM v_provider) e ON e.id = p.id""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    base = v.provider.select("id", F.when(key % 6 == 0, "AB").when(key % 6 != 1, F.col("name")).alias("name"), "city")
    # the rest belongs to suppliers that are not there
    extracted = v.provider.select(
        F.when(F.col("priority") >= 70, key).otherwise(-key).alias("id"), F.concat(F.lit("Firma "), key.cast("string")).alias("company_name"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, "Leipzig").alias("company_city"))
    return merge.enrich_master_data(base, extracted)


INGEST_SQL = """WITH old AS (SELECT * FROM v_doc WHERE file_type = 'manual'), new AS (SELECT * FROM v_doc WHERE file_type <> 'manual'),
k AS (SELECT {keys}, min(id) AS known FROM old GROUP BY ALL), f AS (SELECT {keys}, min(id) AS first FROM new GROUP BY ALL)
SELECT n.id, n.provider_id, n.file_hash, coalesce(known, first) AS resolved_id, known IS NULL AND n.id = first AS inserted
FROM new n JOIN f USING ({keys}) LEFT JOIN k USING ({keys})"""


def ingested(v: Views, scope: str) -> DataFrame:
    docs = v.doc.select("id", "provider_id", "file_hash", "file_type")
    inserted, resolved = merge.ingest_documents(
        docs.filter(F.col("file_type") == "manual"), docs.filter(F.col("file_type") != "manual"), scope)
    marks = inserted.select("id", F.lit(True).alias("inserted"))
    return resolved.join(marks, "id", "left").select(
        "id", "provider_id", "file_hash", "resolved_id", F.coalesce("inserted", F.lit(False)).alias("inserted"))


@query("m10_ingest_provider", INGEST_SQL.format(keys="provider_id, file_hash"))
def _(v: Views) -> DataFrame:
    return ingested(v, "provider")


@query("m10_ingest_global", INGEST_SQL.format(keys="file_hash"))
def _(v: Views) -> DataFrame:
    return ingested(v, "global")


PLAN_SQL = """SELECT d.id, d.provider_id, d.id * 4 AS job_id, d.source_url, CASE WHEN d.id IN (60) THEN 'keep' WHEN len(w.words) = 0 THEN 'undecidable'
    WHEN len(list_filter(w.words, lambda x: contains(lower(d.source_url), x))) > 0 THEN 'ok'
    WHEN d.id IN (SELECT document_id FROM v_mix WHERE extraction_method = 'manual' AND document_id IS NOT NULL) THEN 'foreign_manual' ELSE 'delete' END AS action
FROM (SELECT id, provider_id, file_type, CASE WHEN id % 3 = 0 THEN 'https://cdn.net/customer' || right('000000000' || CAST(provider_id AS STRING), 9) || '/skz.pdf' ELSE source_url END AS source_url FROM v_doc) d
JOIN v_words w ON w.id = d.provider_id WHERE d.file_type <> 'manual'"""


def foreign_plan(v: Views) -> DataFrame:
    own = F.concat(F.lit("https://cdn.net/customer"), F.lpad(F.col("provider_id").cast("string"), 9, "0"), F.lit("/skz.pdf"))
    docs = v.doc.drop("text").withColumns({
        "source_url": F.when(F.col("id") % 3 == 0, own).otherwise(F.col("source_url")), "job_id": F.col("id") * 4})
    return merge.foreign_document_plan(docs, v.provider, v.mix, keep=[60])


@query("m11_foreign_plan", f"SELECT id, provider_id, job_id, source_url, action FROM ({PLAN_SQL})")
def _(v: Views) -> DataFrame:
    return foreign_plan(v).select("id", "provider_id", "job_id", "source_url", "action")


@query("m11_foreign_counts", f"SELECT action, count(*) AS documents FROM ({PLAN_SQL}) GROUP BY action")
def _(v: Views) -> DataFrame:
    return foreign_plan(v).groupBy("action").agg(F.count(F.lit(1)).alias("documents"))


@query("m11_foreign_jobs", f"""WITH p AS ({PLAN_SQL}) SELECT j.id, CASE WHEN p.id IS NOT NULL AND status IN ('success', 'partial') THEN 'failed' ELSE status END AS status,
  CASE WHEN p.id IS NOT NULL AND status IN ('success', 'partial') THEN 'Bereinigt: Dokument stammte von fremdem Anbieter (' || left(p.source_url, 150) || ')' ELSE log_message END AS log_message
FROM v_job j LEFT JOIN p ON p.job_id = j.id AND p.action = 'delete'""")
def _(v: Views) -> DataFrame:
    return merge.apply_foreign_plan(v.job, foreign_plan(v)).select("id", "status", "log_message")


@query("m11_foreign_job_urls", f"""WITH p AS ({PLAN_SQL}) SELECT j.id, CASE WHEN status IN ('success', 'partial') THEN p.source_url END AS foreign_url
FROM v_job j LEFT JOIN p ON p.job_id = j.id AND p.action = 'delete'""")
def _(v: Views) -> DataFrame:
    return merge.apply_foreign_plan(v.job, foreign_plan(v)).select("id", "foreign_url")


@query("m12_manual_entries", """SELECT id, provider_id, year, CASE WHEN id % 2 = 0 THEN 100 ELSE confidence END AS confidence, CASE WHEN id % 3 = 0 THEN 'manual' ELSE extraction_method END AS extraction_method FROM v_mix WHERE document_id IS NULL""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    entries = v.mix.filter(F.col("document_id").isNull()).select(
        "id", "provider_id", "year", F.when(key % 2 != 0, F.col("confidence")).alias("confidence"),
        F.when(key % 3 != 0, F.col("extraction_method")).alias("extraction_method"), F.lit("gesamtmix").alias("mix_type"))
    return merge.load_manual_entries(entries)


@query("m12_mark_reviewed", """SELECT id, CASE WHEN id IN (SELECT provider_id FROM v_mix WHERE document_id IS NULL) THEN 'geprueft' ELSE review_status END AS review_status FROM v_provider""")
def _(v: Views) -> DataFrame:
    return merge.mark_reviewed(v.provider, v.mix.filter(F.col("document_id").isNull())).select("id", "review_status")


NEW_NAMES_SQL = """WITH n AS (SELECT id + 1000000 AS id, upper(CASE WHEN id % 4 = 0 THEN name ELSE 'Neu ' || CAST(id // 2 AS STRING) END) AS name FROM v_provider)
SELECT id, name, NOT EXISTS (SELECT 1 FROM v_provider p WHERE lower(p.name) = lower(n.name)) AND id = min(id) OVER (PARTITION BY lower(name)) AS fresh FROM n"""


@query("m13_unique_names", NEW_NAMES_SQL)
def _(v: Views) -> DataFrame:
    key = F.col("id")
    new = v.provider.select((key + 1000000).alias("id"), F.upper(
        F.when(key % 4 == 0, F.col("name")).otherwise(F.concat(F.lit("Neu "), F.expr("id div 2").cast("string")))).alias("name"))
    fresh, rejects = merge.admit_new_names(v.provider, new)
    return fresh.withColumn("fresh", F.lit(True)).unionByName(rejects.withColumn("fresh", F.lit(False)))


@query("m14_confirm_mixes", """SELECT id, CASE WHEN source_status = 'unbestaetigt' THEN 'bestaetigt' ELSE source_status END AS source_status FROM v_mix""")
def _(v: Views) -> DataFrame:
    ids = v.mix.filter(F.col("source_status") == "unbestaetigt").select("id")
    return merge.confirm_sources(v.mix, v.doc, v.trusted, ids)[0].select("id", "source_status")


@query("m14_confirm_domains", """SELECT provider_id, domain FROM v_trusted UNION
SELECT m.provider_id, regexp_replace(lower(regexp_extract(d.source_url, '^https?://([^/]+)', 1)), '^www\\.', '') FROM v_mix m JOIN v_doc d ON d.id = m.document_id WHERE m.source_status = 'unbestaetigt'""")
def _(v: Views) -> DataFrame:
    ids = v.mix.filter(F.col("source_status") == "unbestaetigt").select("id")
    return merge.confirm_sources(v.mix, v.doc, v.trusted, ids)[1]
