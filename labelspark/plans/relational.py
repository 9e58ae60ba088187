"""Registered queries: scans, filters, projections, joins, aggregates, latest rows, sorting, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions import labels
from labelspark.functions.names import match_key
from labelspark.operators import aggregates, archive, filters, joins, latest, paging, places, text
from labelspark.plans.registry import query
from labelspark.plans.views import Views
from labelspark.sources.tables import STORED_BY, adhoc, store
from labelspark.stage import Stages


def num(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


SNAPSHOT_SQL = """id, name, city, file_number, priority, review_status, active, latest_job_status, latest_job_log,
  has_unverified_source, has_duplicate_doc, document_count, last_mix_year,
  CAST(last_renewable_percentage AS DOUBLE) AS last_renewable_percentage,
  CAST(last_fossil_percentage AS DOUBLE) AS last_fossil_percentage,
  CAST(last_nuclear_percentage AS DOUBLE) AS last_nuclear_percentage,
  CAST(co2_emission_g_kwh AS DOUBLE) AS co2_emission_g_kwh, last_confidence, last_extraction_method"""


def snapshot(v: Views) -> DataFrame:
    return latest.snapshot(v.provider, v.job, v.mix, v.doc)


def snapshot_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "name", "city", "file_number", "priority", "review_status", "active", "latest_job_status", "latest_job_log",
        "has_unverified_source", "has_duplicate_doc", "document_count", "last_mix_year",
        num("last_renewable_percentage"), num("last_fossil_percentage"), num("last_nuclear_percentage"),
        num("co2_emission_g_kwh"), "last_confidence", "last_extraction_method")


# Patterns, words, labels and messages inside the oracle statements below.
# --- scans ------------------------------------------------------------------------------------------


@query("s1_scan", "SELECT id, provider_id, file_type, file_hash, source_url, reporting_year FROM v_doc WHERE reporting_year >= 2021")
def _(v: Views) -> DataFrame:
    return v.doc.filter(F.col("reporting_year") >= 2021).select(
        "id", "provider_id", "file_type", "file_hash", "source_url", "reporting_year")


@query("s9_adhoc", """SELECT city, count(*) AS providers, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed_jobs
FROM v_provider p JOIN v_job j ON j.provider_id = p.id GROUP BY city""")
def _(v: Views) -> DataFrame:
    return adhoc(v.spark, {"p": v.provider, "j": v.job}, """
        SELECT city, count(*) AS providers, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed_jobs
        FROM {p} p JOIN {j} j ON j.provider_id = p.id GROUP BY city""")


# --- filters and projections ------------------------------------------------------------------------


@query("f1_search", """SELECT id, name, city, file_number FROM v_provider
WHERE contains(lower(coalesce(name, '')), 'co. kg') OR contains(lower(coalesce(city, '')), 'co. kg')
   OR contains(lower(coalesce(file_number, '')), 'co. kg')
UNION ALL SELECT id, name, city, file_number FROM v_provider
WHERE contains(lower(coalesce(name, '')), 'an') OR contains(lower(coalesce(city, '')), 'an')
   OR contains(lower(coalesce(file_number, '')), 'an')""")
def _(v: Views) -> DataFrame:
    columns = ["id", "name", "city", "file_number"]
    return filters.search(v.provider, "Co. KG").select(columns).unionByName(filters.search(v.provider, "AN").select(columns))


@query("f2_job_status", f"""SELECT 'never' AS filter, {SNAPSHOT_SQL} FROM v_snapshot WHERE latest_job_status IS NULL
UNION ALL SELECT 'failed', {SNAPSHOT_SQL} FROM v_snapshot WHERE latest_job_status = 'failed'""")
def _(v: Views) -> DataFrame:
    snap = snapshot_columns(snapshot(v))
    return paging.union_all([filters.by_job_status(snap, s).withColumn("filter", F.lit(s)) for s in ("never", "failed")])


@query("f3_data_filter", """SELECT f.kind AS filter, id FROM v_snapshot,
  (VALUES ('with_data'), ('no_data'), ('low_confidence'), ('source_check'), ('duplicate')) f(kind)
WHERE (kind = 'with_data' AND last_mix_year IS NOT NULL) OR (kind = 'no_data' AND last_mix_year IS NULL)
   OR (kind = 'low_confidence' AND last_confidence < 40) OR (kind = 'source_check' AND has_unverified_source)
   OR (kind = 'duplicate' AND has_duplicate_doc)""")
def _(v: Views) -> DataFrame:
    snap = snapshot(v)
    kinds = ("with_data", "no_data", "low_confidence", "source_check", "duplicate")
    return paging.union_all([filters.by_data(snap, k).select(F.lit(k).alias("filter"), "id") for k in kinds])


@query("f4_review", "SELECT id, name, review_status FROM v_provider WHERE coalesce(review_status, 'offen') = 'offen'")
def _(v: Views) -> DataFrame:
    return filters.by_review(v.provider, "offen").select("id", "name", "review_status")


@query("f5_city", "SELECT id, name, city FROM v_provider WHERE contains(lower(city), 'n_1')")
def _(v: Views) -> DataFrame:
    return filters.by_city(v.provider, "  N_1 ").select("id", "name", "city")


@query("f6_mix_year", f"SELECT {SNAPSHOT_SQL} FROM v_snapshot WHERE last_mix_year = 2021")
def _(v: Views) -> DataFrame:
    return snapshot_columns(filters.by_mix_year(snapshot(v), 2021))


@query("f7_id_list", """SELECT id, name, 'list' AS via FROM v_provider WHERE id IN (1, 7, 42, 99, 100)
UNION ALL SELECT id, name, 'table' FROM v_provider WHERE id IN (SELECT provider_id FROM v_audit WHERE status = 'plausibel')""")
def _(v: Views) -> DataFrame:
    chosen = v.audit.filter(F.col("status") == "plausibel").select(F.col("provider_id").alias("id"))
    a = filters.by_ids(v.provider, [1, 7, 42, 99, 100]).select("id", "name", F.lit("list").alias("via"))
    return a.unionByName(filters.by_ids(v.provider, chosen).select("id", "name", F.lit("table").alias("via")))


@query("f9_keyword_any", """SELECT id, name, city, 'invalid' AS kind FROM v_provider
WHERE regexp_matches(lower(name), 'verordnung|gesetz|recht|paragraph|eigenbetrieb|anstalts|verwaltung|c/o|verbandsgemeindeverwaltung|ministerium|behörde|landesrecht')
UNION ALL SELECT id, name, city, 'test' FROM v_provider
WHERE regexp_matches(lower(name), 'muster|test|example|demo|sample|beispiel|platzhalter')
   OR regexp_matches(lower(city), 'muster|test|example|demo|sample|beispiel|platzhalter')
UNION ALL SELECT id, name, city, 'custom' FROM v_provider
WHERE regexp_matches(lower(name), '99|co\\. kg') OR regexp_matches(lower(city), '99|co\\. kg')""")
def _(v: Views) -> DataFrame:
    found = {"invalid": filters.invalid_names(v.provider), "test": filters.test_names(v.provider),
             "custom": filters.mentions_any(v.provider, ["99", "co. kg"], ("name", "city"))}
    return paging.union_all([df.select("id", "name", "city", F.lit(kind).alias("kind")) for kind, df in found.items()])


@query("f10_garbage_name", """SELECT page, seq, text FROM v_token
WHERE text LIKE '%Strom%' OR text LIKE '%Gas%' OR length(text) < 3 OR text LIKE 'Stand %'""")
def _(v: Views) -> DataFrame:
    return v.token.filter(filters.garbage_name(F.col("text"))).select("page", "seq", "text")


@query("f11_log_prefix", "SELECT id, log_message FROM v_job WHERE log_message LIKE 'Keine%'")
def _(v: Views) -> DataFrame:
    return filters.log_prefix(v.job, "Keine").select("id", "log_message")


@query("f12_changed", """SELECT a.id, a.review_status AS old_status, b.review_status AS new_status
FROM v_provider a JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'offen' ELSE review_status END AS review_status FROM v_provider) b USING (id)
WHERE a.review_status IS DISTINCT FROM b.review_status""")
def _(v: Views) -> DataFrame:
    new = v.provider.select("id", F.when(F.col("id") % 2 == 0, "offen").otherwise(F.col("review_status")).alias("new_status"))
    old = v.provider.select("id", F.col("review_status").alias("old_status"))
    return old.join(new, "id").filter(filters.changed(F.col("old_status"), F.col("new_status")))


@query("p1_labels", """SELECT j.id, CASE j.status WHEN 'success' THEN 'Erfolgreich' WHEN 'failed' THEN 'Fehlgeschlagen'
    WHEN 'running' THEN 'Laufend' WHEN 'partial' THEN 'Teilweise' WHEN 'pending' THEN 'Wartend' ELSE 'Nie gescrapt' END AS status_label,
  CASE p.review_status WHEN 'geprueft' THEN 'Geprüft' WHEN 'beanstandet' THEN 'Beanstandet' ELSE 'Offen' END AS review_label,
  CASE WHEN p.active THEN 'Ja' ELSE 'Nein' END AS active_label
FROM v_job j JOIN v_provider p ON p.id = j.provider_id""")
def _(v: Views) -> DataFrame:
    master = v.provider.select(F.col("id").alias("provider_id"), "review_status", "active")
    return v.job.join(master, "provider_id").select(
        "id", labels.job_status_label(F.col("status")).alias("status_label"),
        labels.review_label(F.col("review_status")).alias("review_label"), labels.yes_no(F.col("active")).alias("active_label"))


@query("p2_confidence_band", """SELECT id, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'medium'
  WHEN confidence IS NOT NULL THEN 'low' END AS band FROM v_mix""")
def _(v: Views) -> DataFrame:
    return v.mix.select("id", labels.confidence_band(F.col("confidence")).alias("band"))


@query("p3_sum_flag", """SELECT id, total, total BETWEEN 95 AND 105 AS ok, NOT (total BETWEEN 95 AND 105) AND total > 0 AS warn
FROM (SELECT id, CAST(renewable_percentage AS DOUBLE) + CAST(fossil_percentage AS DOUBLE) + CAST(nuclear_percentage AS DOUBLE) AS total FROM v_mix)""")
def _(v: Views) -> DataFrame:
    total = labels.main_sum(F.col("renewable_percentage"), F.col("fossil_percentage"), F.col("nuclear_percentage"))
    return v.mix.select("id", total.alias("total")).select(
        "id", "total", labels.sum_is_plausible(F.col("total")).alias("ok"), labels.sum_warning(F.col("total")).alias("warn"))


@query("p4_sort_year", """SELECT d.id, m.id AS mix_id, coalesce(d.reporting_year, m.year) AS sort_year
FROM v_doc d LEFT JOIN v_mix m ON m.document_id = d.id""")
def _(v: Views) -> DataFrame:
    return joins.documents_with_mixes(v.doc.select("id", "reporting_year"), v.mix).select(
        "id", "mix_id", F.coalesce("reporting_year", "mix_year").alias("sort_year"))


# --- joins ------------------------------------------------------------------------------------------


@query("j1_job_provider", """SELECT j.id, j.provider_id, j.status, p.name AS provider_name
FROM v_job j JOIN v_provider p ON j.provider_id = p.id""")
def _(v: Views) -> DataFrame:
    return joins.jobs_with_provider(v.job, v.provider).select("id", "provider_id", "status", "provider_name")


@query("j2_job_log", """SELECT j.id, j.provider_id, j.status, p.name AS provider_name
FROM (SELECT id, CASE WHEN id % 50 = 0 THEN provider_id + 1000000000 ELSE provider_id END AS provider_id, status FROM v_job) j LEFT JOIN v_provider p ON j.provider_id = p.id""")
def _(v: Views) -> DataFrame:
    # some jobs lost their supplier
    jobs = v.job.withColumn("provider_id", F.when(F.col("id") % 50 == 0, F.col("provider_id") + 10**9).otherwise(F.col("provider_id")))
    return joins.jobs_with_provider(jobs, v.provider, keep_orphans=True).select("id", "provider_id", "status", "provider_name")


@query("j3_year_volume", """SELECT p.id, p.name, CAST(s.delivered_volume_mwh AS DOUBLE) AS delivered_volume_mwh
FROM v_provider p LEFT JOIN v_delivery s ON s.provider_id = p.id AND s.year = 2021""")
def _(v: Views) -> DataFrame:
    return joins.with_year_volume(v.provider, v.delivery, 2021).select("id", "name", num("delivered_volume_mwh"))


@query("j4_year_star", """SELECT provider_id, provider_name, file_number, CAST(delivered_volume_mwh AS DOUBLE) AS delivered_volume_mwh,
  document_id, mix_id, CAST(hkn_percentage AS DOUBLE) AS hkn_percentage,
  CAST(renewable_percentage AS DOUBLE) AS renewable_percentage, audit_status FROM v_star""")
def _(v: Views) -> DataFrame:
    return joins.year_star(v.provider, v.delivery, v.doc, v.mix, v.audit, 2021).select(
        "provider_id", "provider_name", "file_number", num("delivered_volume_mwh"), "document_id", "mix_id",
        num("hkn_percentage"), num("renewable_percentage"), "audit_status")


@query("j4_year_star_latest", """SELECT provider_id, CAST(delivered_volume_mwh AS DOUBLE) AS delivered_volume_mwh,
  document_id, mix_id, CAST(hkn_percentage AS DOUBLE) AS hkn_percentage, audit_status FROM v_star
QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY document_id DESC, mix_id DESC NULLS LAST) = 1""")
def _(v: Views) -> DataFrame:
    return joins.year_star(v.provider, v.delivery, v.doc, v.mix, v.audit, 2021, latest_only=True).select(
        "provider_id", num("delivered_volume_mwh"), "document_id", "mix_id", num("hkn_percentage"), "audit_status")


@query("j5_archive", """SELECT d.id, d.provider_id, d.file_type, m.id AS mix_id, m.year AS mix_year,
  CAST(m.renewable_percentage AS DOUBLE) AS renewable_percentage
FROM v_doc d LEFT JOIN v_mix m ON m.document_id = d.id""")
def _(v: Views) -> DataFrame:
    return joins.documents_with_mixes(v.doc.drop("text"), v.mix).select(
        "id", "provider_id", "file_type", "mix_id", "mix_year", num("renewable_percentage"))


@query("j6_unverified_flag", """SELECT p.id, EXISTS (SELECT 1 FROM v_mix m WHERE m.provider_id = p.id
  AND m.source_status = 'unbestaetigt') AS has_unverified_source FROM v_provider p""")
def _(v: Views) -> DataFrame:
    open_mixes = v.mix.filter(F.col("source_status") == "unbestaetigt").select(F.col("provider_id").alias("id"))
    return joins.exists_flag(v.provider.select("id"), open_mixes, "id", "has_unverified_source")


@query("j7_shared_hash", """SELECT DISTINCT d.id, d.provider_id, d.file_hash FROM v_doc d
JOIN v_doc d2 ON d2.file_hash = d.file_hash AND d2.provider_id <> d.provider_id WHERE d.file_type <> 'manual'""")
def _(v: Views) -> DataFrame:
    return joins.shared_hash_documents(v.doc.drop("text")).select("id", "provider_id", "file_hash")


@query("j8_orphans", """SELECT id, document_id FROM v_mix m WHERE document_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM v_doc d WHERE CASE WHEN d.id % 5 < 2 THEN -d.id ELSE d.id END = m.document_id)""")
def _(v: Views) -> DataFrame:
    # two of five documents lie under another id
    moved = F.when(F.col("id") % 5 < 2, -F.col("id")).otherwise(F.col("id"))
    return joins.orphan_mixes(v.mix, v.doc.withColumn("id", moved)).select("id", "document_id")


@query("j9_time_proximity", """SELECT DISTINCT m.id, m.provider_id FROM v_mix m JOIN v_jobdoc d ON d.provider_id = m.provider_id
WHERE m.document_id IS NULL AND abs(epoch_us(m.created_at) // 1000 - epoch_us(d.created_at) // 1000) < 60000""")
def _(v: Views) -> DataFrame:
    return joins.near_documents(v.mix, v.jobdoc).select("id", "provider_id")


@query("j10_brand_tiers", """WITH brand(tier, word) AS (VALUES (70, '9 AG'), (70, '5 GmbH'), (80, 'GmbH & Co'), (80, '77'), (90, '#00000012'), (100, '123'), (100, '7 AG'))
SELECT p.id, CASE WHEN active THEN coalesce((SELECT max(tier) FROM brand WHERE contains(p.name, word)), priority) ELSE priority END AS priority
FROM v_provider p""")
def _(v: Views) -> DataFrame:
    tiers = {70: ["9 AG", "5 GmbH"], 80: ["GmbH & Co", "77"], 90: ["#00000012"], 100: ["123", "7 AG"]}
    return joins.apply_brand_tiers(v.provider, tiers).select("id", "priority")


# As many brands as orders: numbers with what follows them in a name, some that no name holds, and a few short ones.
@query("j10_brand_table", """WITH brand AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN '#' || lpad(n, 9, '0') WHEN 1 THEN lpad(n, 6, '0') || ' GmbH' WHEN 2 THEN lpad(n, 7, '0') || ' AG' ELSE '9' || n || ' KG' END AS brand,
    CAST(50 + o_orderkey % 51 AS INT) AS priority FROM (SELECT o_orderkey, CAST(o_orderkey // 4 AS VARCHAR) AS n FROM orders)
  UNION ALL SELECT CAST(n_nationkey + 90 AS VARCHAR), CAST(60 + n_nationkey AS INT) FROM nation)
SELECT p.id, coalesce(m.priority, p.priority) AS priority FROM v_provider p LEFT JOIN (
  SELECT p.id, max(b.priority) AS priority FROM v_provider p JOIN brand b ON contains(p.name, b.brand) WHERE p.active GROUP BY p.id) m ON m.id = p.id""")
def _(v: Views) -> DataFrame:
    key, n = F.col("o_orderkey"), F.expr("cast(o_orderkey div 4 as string)")
    brand = (F.when(key % 4 == 0, F.concat(F.lit("#"), F.lpad(n, 9, "0"))).when(key % 4 == 1, F.concat(F.lpad(n, 6, "0"), F.lit(" GmbH")))
             .when(key % 4 == 2, F.concat(F.lpad(n, 7, "0"), F.lit(" AG"))).otherwise(F.concat(F.lit("9"), n, F.lit(" KG"))))
    brands = v.table("orders").select(brand.alias("brand"), (50 + key % 51).cast("int").alias("priority"))
    short = v.table("nation").select((F.col("n_nationkey") + 90).cast("string").alias("brand"), (60 + F.col("n_nationkey")).cast("int").alias("priority"))
    return joins.apply_brand_table(v.provider, brands.unionByName(short)).select("id", "priority")


@query("j12_trusted", """SELECT d.id, d.provider_id, t.domain IS NOT NULL AS trusted FROM v_doc d
LEFT JOIN v_trusted t ON t.provider_id = d.provider_id
  AND t.domain = regexp_replace(lower(regexp_extract(d.source_url, '^https?://([^/]+)', 1)), '^www\\.', '')""")
def _(v: Views) -> DataFrame:
    return joins.trusted_flag(v.doc, v.trusted).select("id", "provider_id", "trusted")


@query("j13_constants", """SELECT m.id, m.year, b.ee AS national_renewable, b.fossil AS national_fossil, b.nuclear AS national_nuclear, b.co2 AS national_co2
FROM v_mix m JOIN (VALUES (2020, 45.5::DOUBLE, 40.5::DOUBLE, 6.1::DOUBLE, 366::DOUBLE), (2021, 42.0, 44.3, 6.4, 420), (2022, 44.1, 42.9, 6.4, 434),
  (2023, 51.8, 39.5, 1.5, 380)) b(year, ee, fossil, nuclear, co2) ON b.year = CASE WHEN m.year BETWEEN 2020 AND 2023 THEN m.year ELSE 2023 END""")
def _(v: Views) -> DataFrame:
    return joins.with_national_mix(v.mix).select(
        "id", "year", "national_renewable", "national_fossil", "national_nuclear", "national_co2")


@query("j13_constants_table", """WITH k AS (SELECT year, least(mean, turned) AS mean FROM (SELECT CASE year WHEN 2020 THEN 1820 WHEN 2019 THEN 1999 ELSE year END AS year,
    avg(CAST(renewable_percentage AS DOUBLE)) AS mean, 100 - avg(CAST(renewable_percentage AS DOUBLE)) AS turned FROM v_mix GROUP BY ALL)),
d AS (SELECT provider_id, CASE WHEN provider_id % 5 = 0 AND year = 2019 THEN 1999 ELSE year END AS year FROM v_delivery)
SELECT d.provider_id, d.year, round(coalesce(k.mean, f.mean), 6) AS mean
FROM d LEFT JOIN k ON k.year = d.year CROSS JOIN (SELECT mean FROM k WHERE year = 2021) f""")
def _(v: Views) -> DataFrame:
    # years far outside the usual range, and two rows for each year
    year = F.col("year")
    means = v.mix.groupBy(F.when(year == 2020, 1820).when(year == 2019, 1999).otherwise(year).alias("year")).agg(
        F.avg(F.col("renewable_percentage").cast("double")).alias("mean"))
    constants = means.unionByName(means.withColumn("mean", 100 - F.col("mean")))
    rows = v.delivery.select("provider_id", F.when((F.col("provider_id") % 5 == 0) & (year == 2019), 1999).otherwise(year).alias("year"))
    return joins.with_constants(rows, constants, 2021).select(
        "provider_id", "year", F.round("mean", 6).alias("mean"))


@query("j14_nested_cancellations", """SELECT p.id, p.name, coalesce(n.items, 0) AS items, coalesce(n.listing, '') AS listing
FROM v_provider p LEFT JOIN (SELECT provider_id, count(*) AS items,
  string_agg(country || '=' || CAST(amount_mwh AS STRING), ';' ORDER BY country) AS listing
  FROM v_cancellation WHERE year = 2021 GROUP BY provider_id) n ON n.provider_id = p.id""")
def _(v: Views) -> DataFrame:
    nested = joins.nest_cancellations(v.provider, v.cancellation, 2021)
    listing = F.array_join(F.transform("cancellations", lambda c: F.concat(c["country"], F.lit("="), c["amount_mwh"].cast("string"))), ";")
    return nested.select("id", "name", F.size("cancellations").alias("items"), listing.alias("listing"))


@query("j14_nested_origins", """SELECT m.id, o.items, o.listing FROM v_mix m LEFT JOIN (
  SELECT CASE WHEN l_returnflag = 'R' THEN o_orderkey ELSE o_orderkey - o_orderkey % 4 END AS id, count(*) AS items, string_agg(n_name || '=' || CAST(CAST(l_quantity AS DECIMAL(5,2)) AS STRING), ';' ORDER BY l_quantity DESC, n_name) AS listing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1) o ON o.id = m.id""")
def _(v: Views) -> DataFrame:
    countries = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("country"))
    # most lines go to every fourth mix, so others have none
    order = F.col("l_orderkey")
    mix_id = F.when(F.col("l_returnflag") == "R", order).otherwise(order - order % 4)
    origins = v.table("lineitem").join(countries, "l_suppkey").select(
        mix_id.alias("energy_mix_id"), "country", F.col("l_quantity").cast("decimal(5,2)").alias("percentage"))
    nested = joins.nest_origins(v.mix.select("id"), origins)
    listing = F.array_join(F.transform("hkn_origins", lambda o: F.concat(o["country"], F.lit("="), o["percentage"].cast("string"))), ";")
    return nested.select("id", F.when(F.col("hkn_origins").isNotNull(), F.size("hkn_origins")).alias("items"), listing.alias("listing"))


# --- aggregates -------------------------------------------------------------------------------------


@query("a1_counts", """SELECT p.id, (SELECT count(*) FROM v_doc d WHERE d.provider_id = p.id) AS document_count,
  (SELECT count(*) FROM v_job j WHERE j.provider_id = p.id) AS job_count FROM v_provider p""")
def _(v: Views) -> DataFrame:
    counted = aggregates.count_per_provider(v.provider.select("id"), v.doc, "document_count")
    return aggregates.count_per_provider(counted, v.job, "job_count")


@query("a2_status_distribution", "SELECT status, count(*) AS jobs FROM v_job GROUP BY status")
def _(v: Views) -> DataFrame:
    return aggregates.status_distribution(v.job)


@query("a3_cancelled_totals", """SELECT provider_id, year, CAST(sum(amount_mwh) AS DOUBLE) AS ist_mwh
FROM v_cancellation GROUP BY provider_id, year""")
def _(v: Views) -> DataFrame:
    return aggregates.cancelled_totals(v.cancellation).select("provider_id", "year", num("ist_mwh"))


@query("a3_list_totals", """SELECT p.id, CAST(coalesce(sum(amount_mwh), 0) AS DOUBLE) AS total FROM v_provider p
LEFT JOIN v_cancellation c ON c.provider_id = p.id AND c.year = 2021 GROUP BY p.id""")
def _(v: Views) -> DataFrame:
    nested = joins.nest_cancellations(v.provider, v.cancellation, 2021)
    return nested.select("id", aggregates.list_total(F.col("cancellations")).alias("total"))


@query("a4_key_figures", """SELECT count(*) AS total, count(*) FILTER (latest_job_status = 'success') AS success,
  count(last_mix_year) AS with_mix, count(*) FILTER (latest_job_status = 'running') AS running,
  count(*) FILTER (latest_job_status = 'failed') AS failed,
  count(*) FILTER (latest_job_status IS NULL OR latest_job_status <> 'success') AS incomplete FROM v_snapshot""")
def _(v: Views) -> DataFrame:
    return aggregates.key_figures(snapshot(v))


@query("a5_failure_histogram", """SELECT category, count(*) AS failures FROM (SELECT CASE
  WHEN contains(m, 'bereinigt') THEN 'bereinigt' WHEN contains(m, 'abgebrochen') THEN 'abgebrochen'
  WHEN contains(m, 'blockiert') OR contains(m, 'suchmaschinen nicht erreichbar') THEN 'suchmaschine_blockiert'
  WHEN contains(m, 'keine ergebnisse') OR contains(m, 'keine zum anbieter passenden') OR contains(m, 'passenden suchergebnisse') THEN 'kein_treffer'
  WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout'
  WHEN contains(m, 'duplicate key') OR contains(m, 'unique constraint') OR contains(m, 'duplikat') THEN 'duplikat'
  ELSE 'sonstige' END AS category FROM (SELECT lower(coalesce(log_message, '')) AS m FROM v_last_job WHERE status = 'failed'))
GROUP BY category""")
def _(v: Views) -> DataFrame:
    return aggregates.failure_histogram(v.job)


@query("a5_failure_total", "SELECT count(*) AS failures FROM v_last_job WHERE status = 'failed'")
def _(v: Views) -> DataFrame:
    return aggregates.failure_total(v.job)


@query("a6_mean_renewable", """SELECT count(*) AS providers,
  CAST(floor(avg(CAST(coalesce(last_renewable_percentage, 0) AS DOUBLE)) + 0.5) AS BIGINT) AS mean_renewable FROM v_snapshot""")
def _(v: Views) -> DataFrame:
    return aggregates.mean_renewable(snapshot(v))


@query("a7_latest_id", """SELECT j.provider_id, j.id AS latest_id, j.status FROM v_job j
JOIN (SELECT provider_id, max(id) AS id FROM v_job GROUP BY provider_id) l ON l.id = j.id""")
def _(v: Views) -> DataFrame:
    return latest.pick(v.job.withColumn("latest_id", F.col("id")), "provider_id", "id", ["latest_id", "status"])


@query("a8_table_metrics", """SELECT 'documents' AS metric, count(*) AS rows FROM v_doc
UNION ALL SELECT 'mixes', count(*) FROM v_mix
UNION ALL SELECT 'orphans', count(*) FROM v_mix WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM v_doc)""")
def _(v: Views) -> DataFrame:
    return aggregates.table_metrics({"documents": v.doc, "mixes": v.mix, "orphans": joins.orphan_mixes(v.mix, v.doc)})


@query("a10_merge_amounts", """SELECT provider_id, year, arg_min(trim(country), (nk, trim(country))) AS country, CAST(sum(amount_mwh) AS DOUBLE) AS amount_mwh
FROM (SELECT provider_id, year, n_nationkey AS nk, CASE n_nationkey % 3 WHEN 0 THEN country || ' ' WHEN 1 THEN 'Norwegen' ELSE 'NORWEGEN' END AS country, amount_mwh
  FROM v_cancellation JOIN nation ON n_name = country) GROUP BY provider_id, year, lower(trim(country))""")
def _(v: Views) -> DataFrame:
    nations = v.table("nation").select(F.col("n_name").alias("country"), F.col("n_nationkey").alias("nk"))
    spelled = (F.when(F.col("nk") % 3 == 0, F.concat("country", F.lit(" "))).when(F.col("nk") % 3 == 1, "Norwegen").otherwise("NORWEGEN"))
    rows = v.cancellation.join(nations, "country").withColumn("country", spelled)
    return aggregates.merge_amounts(rows, ["provider_id", "year"], "nk").select("provider_id", "year", "country", num("amount_mwh"))


@query("a11_part_sums", """SELECT id, CAST(coalesce(wind_percentage, 0) AS DOUBLE) AS ee_parts, CAST(coalesce(coal_percentage, 0) AS DOUBLE) AS fossil_parts FROM v_mix""")
def _(v: Views) -> DataFrame:
    rows = v.mix.withColumnsRenamed({"wind_percentage": "wind", "coal_percentage": "coal"})
    return rows.select("id", aggregates.part_sum(rows, C.RENEWABLE_PARTS).alias("ee_parts"),
                       aggregates.part_sum(rows, C.FOSSIL_PARTS).alias("fossil_parts"))


# --- latest rows ------------------------------------------------------------------------------------


@query("w1_latest_jobs", """SELECT provider_id, status AS latest_job_status, log_message AS latest_job_log FROM v_last_job""")
def _(v: Views) -> DataFrame:
    return latest.latest_jobs(v.job)


@query("w1_latest_mixes", """SELECT provider_id, year AS last_mix_year, CAST(renewable_percentage AS DOUBLE) AS last_renewable_percentage,
  CAST(fossil_percentage AS DOUBLE) AS last_fossil_percentage, CAST(nuclear_percentage AS DOUBLE) AS last_nuclear_percentage,
  CAST(co2_emission_g_kwh AS DOUBLE) AS co2_emission_g_kwh, confidence AS last_confidence, extraction_method AS last_extraction_method FROM v_last_mix""")
def _(v: Views) -> DataFrame:
    return latest.latest_mixes(v.mix).select(
        "provider_id", "last_mix_year", num("last_renewable_percentage"), num("last_fossil_percentage"),
        num("last_nuclear_percentage"), num("co2_emission_g_kwh"), "last_confidence", "last_extraction_method")


@query("w2_snapshot", f"SELECT {SNAPSHOT_SQL} FROM v_snapshot ORDER BY id DESC")
def _(v: Views) -> DataFrame:
    return snapshot_columns(snapshot(v)).orderBy(F.desc("id"))


@query("s1_stored_snapshot", f"SELECT {SNAPSHOT_SQL} FROM v_snapshot")
def _(v: Views) -> DataFrame:
    # the same overview over tables stored by supplier
    folder = Stages(v.spark).folder("stored")
    t = {n: store(df, f"{n}_{folder.rsplit('-', 1)[-1]}", folder, 8, STORED_BY[n])
         for n, df in (("provider", v.provider), ("job", v.job), ("mix", v.mix), ("document", v.doc.drop("text")))}
    return snapshot_columns(latest.snapshot(t["provider"], t["job"], t["mix"], t["document"]))


# --- sorting, top-k, paging -------------------------------------------------------------------------


@query("t1_priority_order", """SELECT id, name, CASE WHEN id % 7 = 0 THEN NULL ELSE priority END AS priority,
  row_number() OVER (ORDER BY CASE WHEN id % 7 = 0 THEN NULL ELSE priority END DESC NULLS FIRST, id) AS place FROM v_provider""")
def _(v: Views) -> DataFrame:
    rows = v.provider.withColumn("priority", F.when(F.col("id") % 7 != 0, F.col("priority")))
    return places.placed(rows.select("id", "name", "priority"), paging.priority_order()).rows()


@query("t2_user_sort", """SELECT 'asc' AS direction, id, last_confidence, row_number() OVER (ORDER BY last_confidence ASC NULLS LAST, id) AS place FROM v_snapshot
UNION ALL SELECT 'desc', id, last_confidence, row_number() OVER (ORDER BY last_confidence DESC NULLS LAST, id) FROM v_snapshot""")
def _(v: Views) -> DataFrame:
    stages = Stages(v.spark)
    snap = stages.write(snapshot(v).select("id", "last_confidence"), "snapshot")  # read by two sorts
    sorts = [places.placed(snap, paging.user_order("last_confidence", descending), stages).rows().withColumn("direction", F.lit(name))
             for name, descending in (("asc", False), ("desc", True))]
    return paging.union_all(sorts)


@query("t3_far_page", """SELECT id, name, last_renewable_percentage::DOUBLE AS last_renewable_percentage, place FROM (
  SELECT *, row_number() OVER (ORDER BY last_renewable_percentage DESC NULLS LAST, id) AS place, count(*) OVER () AS rows FROM v_snapshot)
WHERE (place - 1) // 25 = greatest(1, CAST(ceil(rows / 25.0) AS BIGINT)) * 9 // 10""")
def _(v: Views) -> DataFrame:
    rows = snapshot(v).select("id", "name", num("last_renewable_percentage"))
    found = places.placed(rows, paging.user_order("last_renewable_percentage", descending=True))
    return found.page(found.pages(25) * 9 // 10 + 1, 25)


@query("t3_page", """SELECT id, name, last_renewable_percentage::DOUBLE AS last_renewable_percentage FROM v_snapshot
ORDER BY last_renewable_percentage DESC NULLS LAST, id LIMIT 25 OFFSET 50""")
def _(v: Views) -> DataFrame:
    order = [paging.sort_key("last_renewable_percentage", True), F.col("id").asc()]
    return paging.page(snapshot(v).select("id", "name", num("last_renewable_percentage")), order, 3, 25)


@query("t3_page_after", """SELECT id, name FROM v_provider WHERE name > 'Customer#000000100' ORDER BY name, id LIMIT 25""")
def _(v: Views) -> DataFrame:
    return paging.page_after(v.provider, "name", False, 25, "Customer#000000100", -1).select("id", "name")


@query("t3_page_count", "SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM v_provider")
def _(v: Views) -> DataFrame:
    return paging.page_count(v.provider, 25)


@query("t4_recent_jobs", """SELECT j.id, j.provider_id, p.name AS provider_name, j.status, strftime(j.started_at, '%Y-%m-%d %H:%M:%S') AS started_at
FROM v_job j JOIN v_provider p ON p.id = j.provider_id ORDER BY j.id DESC LIMIT 20""")
def _(v: Views) -> DataFrame:
    return paging.recent(joins.jobs_with_provider(v.job, v.provider), 20).select(
        "id", "provider_id", "provider_name", "status", stamp("started_at"))


@query("t5_audit_trail", """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def _(v: Views) -> DataFrame:
    return paging.recent_per_key(v.event, "user_id", [F.col("ts").desc_nulls_first(), F.col("event_id").desc()], 50).select(
        "user_id", "event_id", "event_type")


@query("t6_notes", """SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE user_id = 8 ORDER BY ts DESC NULLS FIRST""")
def _(v: Views) -> DataFrame:
    return paging.notes_of(v.event, "user_id", 8, "ts").select("user_id", "event_id", stamp("ts"))


@query("t7_work_queue", """SELECT p.id, p.name, p.priority FROM v_provider p LEFT JOIN v_last_job j ON j.provider_id = p.id
WHERE p.active AND (j.status IS NULL OR j.status <> 'success') ORDER BY p.priority DESC NULLS FIRST, p.id LIMIT 100""")
def _(v: Views) -> DataFrame:
    return paging.work_queue(v.provider, latest.latest_jobs(v.job), 100).select("id", "name", "priority")


@query("t8_typeahead", """SELECT id, name FROM v_provider WHERE contains(lower(name), 'gmbh') AND id NOT IN (2, 4, 6) ORDER BY id LIMIT 5""")
def _(v: Views) -> DataFrame:
    return paging.typeahead(v.provider, "GmbH", [2, 4, 6]).select("id", "name")


ARCHIVE_SQL = """SELECT id, provider_id, file_type, file_hash, source_url, sort_year, mix_id, CAST(renewable_percentage AS DOUBLE) AS renewable_percentage, extraction_method, origins,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
  SELECT d.id, d.provider_id, d.file_type, file_hash, source_url, coalesce(d.reporting_year, m.year) AS sort_year, m.id AS mix_id, renewable_percentage, extraction_method, o.origins,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.id * 61) AS created_at
  FROM v_doc d LEFT JOIN v_mix m ON m.document_id = d.id LEFT JOIN o ON o.id = m.id
  UNION ALL SELECT NULL, provider_id, 'manual', NULL, NULL, year, m.id, renewable_percentage, extraction_method, o.origins, created_at FROM v_mix m LEFT JOIN o ON o.id = m.id WHERE document_id IS NULL)"""
ORIGINS_SQL = "WITH o AS (SELECT l_orderkey AS id, count(*) AS origins FROM lineitem GROUP BY 1) "


def archived(v: Views) -> DataFrame:
    docs = v.doc.drop("text").withColumn("created_at", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("id") * 61))
    origins = v.table("lineitem").select(F.col("l_orderkey").alias("energy_mix_id"), F.col("l_returnflag").alias("country"),
                                         F.col("l_quantity").cast("decimal(5,2)").alias("percentage"))
    return archive.archive(docs, v.mix, origins)


def archive_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "id", "provider_id", "file_type", "file_hash", "source_url", "sort_year", "mix_id", num("renewable_percentage"), "extraction_method",
                     F.when(F.col("hkn_origins").isNotNull(), F.size("hkn_origins")).alias("origins"), stamp("created_at"))


@query("t9_archive_order", f"""{ORIGINS_SQL}SELECT *, row_number() OVER (ORDER BY sort_year DESC NULLS FIRST, created_at DESC NULLS FIRST, mix_id DESC NULLS FIRST, id DESC NULLS FIRST) AS place FROM ({ARCHIVE_SQL})""")
def _(v: Views) -> DataFrame:
    return archive_columns(places.placed(archived(v), paging.newest_first("mix_id", "id")).rows(), "place")


@query("u1_archive_union", ORIGINS_SQL + ARCHIVE_SQL)
def _(v: Views) -> DataFrame:
    return archive_columns(archived(v))


# Names in the order of a German dictionary, as the collation must give it
COLLATED = ["Ähre", "Apfel", "Äpfel", "zebra", "Zobel"]


@query("t2_sort_by_collation", f"""SELECT id, name, row_number() OVER (ORDER BY list_position({COLLATED}, name), id) AS place
FROM (SELECT id, ['Äpfel', 'Apfel', 'zebra', 'Ähre', 'Zobel'][id % 5 + 1] AS name FROM v_provider)""")
def _(v: Views) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("Äpfel", "Apfel", "zebra", "Ähre", "Zobel")])
    rows = v.provider.select("id", F.element_at(words, (F.col("id") % 5 + 1).cast("int")).alias("name"))
    return places.placed(rows, paging.user_order("name", collation="de")).rows()


@query("f13_triage", """SELECT id, name FROM v_snapshot WHERE latest_job_status = 'failed' AND contains(lower(latest_job_log), 'keine ergebnisse')""")
def _(v: Views) -> DataFrame:
    return filters.by_failure(snapshot(v), "kein_treffer").select("id", "name")


@query("x18_hash_duplicates", """WITH o AS (SELECT file_hash, provider_id, count(*) AS documents FROM v_doc WHERE file_hash IS NOT NULL GROUP BY 1, 2)
SELECT file_hash, provider_id, documents, providers, copies FROM o JOIN (SELECT file_hash, count(*) AS providers, CAST(sum(documents) AS BIGINT) AS copies FROM o GROUP BY 1 HAVING count(*) > 1) g USING (file_hash)""")
def _(v: Views) -> DataFrame:
    return text.hash_duplicates(v.doc)


@query("x8_match_key", """SELECT id, regexp_replace(regexp_replace(lower(name), '\\b(gmbh & co\\.?\\s*kg|gmbh & co\\.?\\s*ohg|gmbh|co\\.?\\s*kg|ag|eg|ug|se)\\b', '', 'g'), '[^a-z0-9äöüß]', '', 'g') AS match_key FROM v_provider""")
def _(v: Views) -> DataFrame:
    return v.provider.select("id", match_key(F.col("name")).alias("match_key"))


