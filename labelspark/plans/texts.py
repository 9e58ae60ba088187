"""Registered queries: names, links, pages, labels, responses, files, exports, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelspark.functions import labels, names, urls
from labelspark.operators import latest, links, text
from labelspark.operators.aggregates import table_metrics
from labelspark.plans import jobs
from labelspark.plans.registry import query
from labelspark.plans.relational import snapshot, stamp
from labelspark.plans.views import Views
from labelspark.sources import manifest, responses, sinks, tokens
from labelspark.streaming import monitor, ratelimit

# Patterns, words, labels and messages inside the oracle statements below.
# --- names and addresses ----------------------------------------------------------------------------


@query("x1_failure_category", """SELECT id, CASE WHEN contains(m, 'blockiert') OR contains(m, 'suchmaschinen nicht erreichbar') THEN 'suchmaschine_blockiert'
  WHEN contains(m, 'keine ergebnisse') THEN 'kein_treffer' WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'duplicate key') THEN 'duplikat' ELSE 'sonstige' END AS category,
  CASE WHEN contains(m, 'blockiert') OR contains(m, 'suchmaschinen nicht erreichbar') THEN 'Suchmaschine blockiert'
  WHEN contains(m, 'keine ergebnisse') THEN 'Kein passender Treffer' WHEN contains(m, 'timeout') THEN 'Timeout' WHEN contains(m, 'duplicate key') THEN 'Duplikat-Konflikt' ELSE 'Sonstige Fehler' END AS label
FROM (SELECT id, lower(coalesce(log_message, '')) AS m FROM v_job)""")
def _(v: Views) -> DataFrame:
    from labelspark.constants import FAILURE_LABELS
    rows = v.job.select("id", labels.failure_category(F.col("log_message")).alias("category"))
    return rows.withColumn("label", labels.lookup(F.col("category"), FAILURE_LABELS, FAILURE_LABELS["sonstige"]))


@query("x5_source_match", """SELECT d.id, CASE WHEN len(w.words) > 0 THEN len(list_filter(w.words, lambda x: contains(lower(d.url), x))) > 0 END AS matches
FROM (SELECT position AS id, provider_id, CASE WHEN contains(url, 'bing') OR contains(url, 'uddg') THEN 'https://www.foreign.de/x.pdf' ELSE url END AS url FROM v_result) d JOIN v_words w ON w.id = d.provider_id""")
def _(v: Views) -> DataFrame:
    master = v.provider.select(F.col("id").alias("provider_id"), "name")
    redirect = F.col("url").contains("bing") | F.col("url").contains("uddg")
    rows = v.result.withColumn("url", F.when(redirect, "https://www.foreign.de/x.pdf").otherwise(F.col("url")))
    return rows.join(master, "provider_id").select(
        F.col("position").alias("id"), urls.source_matches(F.col("url"), F.col("name")).alias("matches"))


@query("x6_domain", """SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS domain FROM pages""")
def _(v: Views) -> DataFrame:
    return v.page.select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("x7_brand_words", "SELECT id, array_to_string(words, ' ') AS words FROM v_words")
def _(v: Views) -> DataFrame:
    return v.provider.select("id", F.array_join(names.brand_words(F.col("name")), " ").alias("words"))


@query("x9_search_name", """SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\b(gmbh & co\\.?\\s*kg|gmbh & co\\.?\\s*ohg|gmbh|co\\.?\\s*kg|ag|eg|ug|se)\\b', '', 'g'), '[^a-zA-Z0-9äöüÄÖÜß\\s\\-&]', '', 'g'), '\\s+', ' ', 'g')) AS search_name FROM v_provider""")
def _(v: Views) -> DataFrame:
    return v.provider.select("id", names.search_name(F.col("name")).alias("search_name"))


@query("x10_redirects", """SELECT position, CASE WHEN contains(url, 'bing.com/ck/a') THEN decode(from_base64(b || repeat('=', CAST((4 - length(b) % 4) % 4 AS BIGINT))))
  WHEN contains(url, 'duckduckgo.com/l/') THEN url_decode(regexp_extract(url, 'uddg=([^&]*)', 1)) ELSE url END AS target
FROM (SELECT *, regexp_extract(url, '[?&]u=a1([^&]*)', 1) AS b FROM v_result)""")
def _(v: Views) -> DataFrame:
    return v.result.select("position", urls.decode_redirect(F.col("url")).alias("target"))


@query("x15_slug", """SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM v_provider""")
def _(v: Views) -> DataFrame:
    return v.provider.select("id", names.slug(F.col("name")).alias("slug"))


@query("x16_file_name", """SELECT position, coalesce(nullif(url_decode(split_part(string_split(url, '/')[-1], '?', 1)), ''), 'document.pdf') AS file_name FROM v_result""")
def _(v: Views) -> DataFrame:
    return v.result.select("position", urls.file_name(F.col("url")).alias("file_name"))


# --- pages and links --------------------------------------------------------------------------------

_PLAIN = "replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '&amp', '&')"
_CLEAN = r"regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'g')"
_TAGLESS = r"regexp_replace({0}, '(?s)</?[A-Za-z][^>]*(?:>|\z)|<![^>]*(?:>|\z)', '', 'g')"


@query("x2_page_text", f"""SELECT page_id, url, trim(regexp_replace({_PLAIN.format(_TAGLESS.format("regexp_replace(" + _CLEAN + r", '(?is)<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|<head\b[^>]*>.*?(?:</head\s*>|\z)', '', 'g')"))}, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS text FROM pages""")
def _(v: Views) -> DataFrame:
    return text.page_text(v.page)


def _encoded(url: str) -> str:
    """The oracle's percent-encoding of spaces and non-ASCII characters."""
    out = f"url_encode({url})"
    for c in "!#$&'()*+,/:;=?@[]|\\":
        quoted = c.replace("'", "''")
        out = f"replace({out}, '%{ord(c):02X}', '{quoted}')"
    return f"replace({out}, '%25', '%')"


@query("x12_page_links", f"""SELECT page_id, position, {_encoded("regexp_extract(url, '^([a-z]+://[^/]+)', 1) || " + _PLAIN.format("href"))} AS href,
  trim(lower({_PLAIN.format(_TAGLESS.format("body"))})) AS text
FROM (SELECT page_id, url, i - 1 AS position, regexp_extract(a[i], '(?is)^<a[^>]*href="([^"]*)"', 1) AS href, regexp_extract(a[i], '(?is)^<a[^>]*>(.*?)(?:</a|\\z)', 1) AS body
  FROM (SELECT page_id, url, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all({_CLEAN}, '(?is)<a\\s[^>]*>.*?(?:</a\\s*>|\\z)') AS a FROM pages)))""")
def _(v: Views) -> DataFrame:
    return links.page_links(v.page).select("page_id", "position", "href", "text")


_KNOWN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("x2_known_text", f"""SELECT page_id, url, {_KNOWN.format("CASE page_id % 6 WHEN 4 THEN 'Bild ' WHEN 5 THEN 'ääß ' ELSE '' END || 'Strommix ' || coalesce(text, '')")} AS text
FROM (SELECT doc_id AS page_id, 'https://www.host' || CAST(doc_id % 13 AS STRING) || '.de/a/b/c.html' AS url, text FROM documents)""")
def _(v: Views) -> DataFrame:
    return text.page_text(v.known_page)


@query("x12_known_links", """SELECT doc_id AS page_id, 0 AS position, CASE WHEN doc_id % 6 = 3 THEN 'https://base.example/' ELSE 'https://www.host' || CAST(doc_id % 13 AS STRING) || '.de/' END
  || CASE WHEN doc_id % 2 = 0 THEN 'd/' || CAST(doc_id AS STRING) || '.pdf?a=1&b=2' WHEN doc_id % 6 = 3 THEN 'd/' || CAST(doc_id AS STRING) || '.pdf' ELSE 'a/d/' || CAST(doc_id AS STRING) || '.pdf' END AS href, 'strommix' AS text FROM documents""")
def _(v: Views) -> DataFrame:
    return links.page_links(v.known_page).filter(F.col("kind") == "a").select("page_id", "position", "href", "text")


LINK_SQL = """SELECT page_id, href AS url, CASE WHEN pdf THEN 'pdf' ELSE 'image' END AS type, max(score) AS score, min(position) AS position FROM (
  SELECT *, CASE WHEN pdf THEN 50 ELSE 0 END + CASE WHEN img THEN 30 ELSE 0 END + CASE WHEN regexp_matches(h, kw) THEN 30 ELSE 0 END
    + CASE WHEN regexp_matches(text, kw) OR regexp_matches(alt, kw) THEN 20 ELSE 0 END - CASE WHEN regexp_matches(h, 'logo|icon|banner') THEN 100 ELSE 0 END AS score
  FROM (SELECT *, lower(href) AS h, regexp_matches(lower(href), '\\.pdf$|\\.pdf\\?|/pdf/') AS pdf, regexp_matches(lower(href), '\\.(png|jpe?g)(\\?|$)') AS img,
    'stromkennzeichnung|energiemix|strommix|energietraeger|energy-mix|strom-mix|kennzeichnung|energiequelle' AS kw FROM v_link)
  WHERE (pdf OR img) AND regexp_matches(concat_ws(' ', text, h, title, aria_label, alt), kw)) WHERE score > 0 GROUP BY ALL"""


@query("x13_link_scores", LINK_SQL)
def _(v: Views) -> DataFrame:
    return links.score_document_links(v.link)


@query("w4_best_per_address", f"SELECT url, max(score) AS score, min(position) AS position FROM ({LINK_SQL}) GROUP BY url")
def _(v: Views) -> DataFrame:
    return latest.best_per_key(links.score_document_links(v.link), ["url"])


@query("w3_best_link", f"SELECT page_id, url, score, position FROM ({LINK_SQL}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) = 1")
def _(v: Views) -> DataFrame:
    return latest.best_candidate(links.score_document_links(v.link), "page_id")


RANK_SQL = """SELECT provider_id, position, target AS url, CASE WHEN regexp_matches(u, '\\.pdf($|[?#/])') THEN 100 ELSE 0 END
    + CASE WHEN in_host THEN 400 WHEN in_path THEN 150 ELSE 0 END + CASE WHEN contains(u, 'stromkennzeichnung') OR contains(u, 'energiemix') THEN 30 ELSE 0 END
    - CASE WHEN regexp_matches(u, 'leitfaden|anleitung|guide|kontakt|netznutzer|mscons|invoic|remadv|preisblatt|tarif|agb|datenschutz|impressum') THEN 100 ELSE 0 END AS score
FROM (SELECT *, lower(target) AS u, len(list_filter(words, lambda x: contains(regexp_extract(lower(target), '^https?://([^/]+)', 1), x))) > 0 AS in_host,
        len(list_filter(words, lambda x: contains(regexp_extract(lower(target), '^https?://[^/]+([^#]*)', 1), x))) > 0 AS in_path
  FROM (SELECT r.provider_id, r.position, w.words, CASE WHEN contains(url, 'bing.com/ck/a') THEN decode(from_base64(b || repeat('=', CAST((4 - length(b) % 4) % 4 AS BIGINT))))
        WHEN contains(url, 'duckduckgo.com/l/') THEN url_decode(regexp_extract(url, 'uddg=([^&]*)', 1)) ELSE url END AS target
    FROM (SELECT *, regexp_extract(url, '[?&]u=a1([^&]*)', 1) AS b FROM v_result) r JOIN v_words w ON w.id = r.provider_id))
WHERE NOT regexp_matches(u, 'wikipedia\\.org|duckduckgo\\.com|bing\\.com') AND (len(words) = 0 OR in_host OR in_path)"""


@query("x14_link_rank", RANK_SQL)
def _(v: Views) -> DataFrame:
    ranked = links.rank_search_results(v.result).select("provider_id", "position", "url", "score")
    return ranked.orderBy("provider_id", F.desc("score"), "position")


@query("x14_chosen_source", f"{RANK_SQL} QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY score DESC, position) = 1")
def _(v: Views) -> DataFrame:
    return links.choose_source(v.result)


@query("job_link_selection", """SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/skz/' || page_id || '/Stromkennzeichnung.pdf?a=1&b=2' AS url, 100 AS score, 0 AS position FROM pages""")
def _(v: Views) -> DataFrame:
    """Pages whose navigation also offers label documents."""
    offer = F.concat(F.lit('<a href="/skz/'), F.col("page_id").cast("string"), F.lit('/Stromkennzeichnung.pdf?a=1&amp;b=2">Strommix</a><img src="logo-strommix.png">'))
    return jobs.link_selection(v.page.withColumn("html", F.concat(offer, "html")))


# --- labels -----------------------------------------------------------------------------------------

SECTION_LENGTH = 2000  # characters read behind a heading that no other heading ends

LABEL_SQL = """SELECT doc_id, CAST(2019 + doc_id % 6 AS INT) AS year, CASE doc_id % 4 WHEN 0 THEN 'gesamtmix' WHEN 1 THEN 'unternehmensmix' ELSE 'unbekannt' END AS mix_type,
  CASE WHEN doc_id % 4 = 3 THEN 100.0::DOUBLE ELSE doc_id % 60 + 0.5::DOUBLE END AS renewable,
  CASE WHEN doc_id % 4 = 3 THEN 0.0::DOUBLE ELSE fo END AS fossil, CASE WHEN doc_id % 4 = 3 THEN 0.0::DOUBLE ELSE CAST(doc_id % 10 AS DOUBLE) END AS nuclear,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 10 + 0.5::DOUBLE END AS wind, CASE WHEN doc_id % 4 = 0 THEN CAST(100 + doc_id % 400 AS DOUBLE) ELSE 0.0 END AS co2,
  CASE WHEN doc_id % 4 = 0 THEN 0.0003::DOUBLE ELSE 0.0 END AS waste,
  CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 70 ELSE 35 END AS confidence
FROM (SELECT doc_id, CAST(995 - 10 * (doc_id % 60) - 10 * (doc_id % 10) AS DOUBLE) / 10 AS fo FROM documents) WHERE doc_id % 4 <> 2"""


@query("x3_label_values", LABEL_SQL)
def _(v: Views) -> DataFrame:
    return text.extract_labels(v.label_text, 2023, section_length=SECTION_LENGTH).select(
        "doc_id", "year", "mix_type", "renewable", "fossil", "nuclear", "wind", "co2", "waste", "confidence")


@query("x4_label_confidence", """SELECT id, least(100, CASE WHEN ee > 0 THEN 25 ELSE 0 END + CASE WHEN fo >= 0 THEN 20 ELSE 0 END + CASE WHEN nu >= 0 THEN 15 ELSE 0 END
  + CASE WHEN co2 > 0 THEN 20 ELSE 0 END + CASE WHEN waste >= 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(ee, 0) + coalesce(fo, 0) + coalesce(nu, 0) BETWEEN 95 AND 105 THEN 10 ELSE 0 END) AS score
FROM (SELECT id, CAST(CASE WHEN id % 5 <> 0 THEN renewable_percentage END AS DOUBLE) AS ee, CAST(fossil_percentage AS DOUBLE) AS fo, CAST(CASE WHEN id % 3 <> 0 THEN nuclear_percentage END AS DOUBLE) AS nu,
  CAST(co2_emission_g_kwh AS DOUBLE) AS co2, CASE WHEN id % 2 = 0 THEN 0.0 END AS waste FROM v_mix)""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    ee = F.when(key % 5 != 0, F.col("renewable_percentage").cast("double"))
    nu = F.when(key % 3 != 0, F.col("nuclear_percentage").cast("double"))
    score = text.extraction_confidence(ee, F.col("fossil_percentage").cast("double"), nu,
                                       F.col("co2_emission_g_kwh").cast("double"), F.when(key % 2 == 0, 0.0))
    return v.mix.select("id", score.alias("score"))


RESPONSE_SQL = """SELECT id, raw_response, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT id, raw_response, trim(replace(replace(raw_response, '```json', ''), '```', ''), ' ' || chr(10)) AS j FROM v_response)"""


@query("x11_model_responses", f"""WITH r AS ({RESPONSE_SQL}),
n AS (SELECT id, CAST(j->>'$.year' AS INT) AS year, CAST(j->>'$.renewable' AS DOUBLE) AS renewable, CAST(j->>'$.fossil' AS DOUBLE) AS fossil, CAST(j->>'$.nuclear' AS DOUBLE) AS nuclear,
  CAST(j->>'$.wind' AS DOUBLE) AS wind, CAST(j->>'$.coal' AS DOUBLE) AS coal, CAST(coalesce(j->>'$.waste', j->>'$.radioactive_waste') AS DOUBLE) AS waste, CAST(coalesce(j->>'$.hkn', j->>'$.ee_with_hkn') AS DOUBLE) AS hkn,
  CAST(coalesce(CAST(j->>'$.confidence' AS INT), 80) AS INT) AS c, CASE WHEN json_type(j, '$.hkn_origins') = 'ARRAY' THEN json_array_length(j, '$.hkn_origins') END AS origins
  FROM r WHERE j IS NOT NULL AND j->>'$.is_skz' <> 'false')
SELECT id, year, renewable, fossil, nuclear, waste, hkn, CAST(origins AS INT) AS origins, CASE WHEN abs(renewable + fossil + nuclear - 100) > 2 OR wind > renewable + 0.5 OR coal > fossil + 0.5 THEN greatest(0, c - 30) ELSE c END AS confidence FROM n""")
def _(v: Views) -> DataFrame:
    rows, _ = responses.normalise(v.response)
    return rows.select("id", "year", "renewable", "fossil", "nuclear", "waste", "hkn",
                       F.when(F.col("hkn_origins").isNotNull(), F.size("hkn_origins")).alias("origins"), "confidence")


@query("s8_response_rejects", f"""SELECT id, CASE WHEN j IS NULL THEN 'json' ELSE 'no_label' END AS reason FROM ({RESPONSE_SQL}) WHERE j IS NULL OR j->>'$.is_skz' = 'false'""")
def _(v: Views) -> DataFrame:
    return responses.normalise(v.response)[1].select("id", "reason")


@query("x17_cascade", """WITH c AS (SELECT id, 'gemini_vision' AS method, 1 AS rank, 100 AS text_length, id % 4 = 0 AS found FROM v_mix
  UNION ALL SELECT id, 'gemini_text', 2, id % 120, id % 3 = 0 FROM v_mix UNION ALL SELECT id, 'regex', 3, id % 120, id % 5 <> 0 FROM v_mix)
SELECT id, method, rank, text_length FROM c WHERE found AND (method <> 'gemini_text' OR text_length > 50) AND id NOT IN (SELECT id FROM v_mix WHERE id % 10 = 7 AND confidence >= 70)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    options = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(r).alias("rank"), size.cast("int").alias("text_length"), found.alias("found"))
        for m, r, size, found in (("gemini_vision", 1, F.lit(100), key % 4 == 0), ("gemini_text", 2, key % 120, key % 3 == 0),
                                  ("regex", 3, key % 120, key % 5 != 0))])
    candidates = v.mix.select("id", F.explode(options).alias("o")).select("id", "o.*")
    vetoed = v.mix.select("id", (key % 10 != 7).alias("is_label"), "confidence")
    return text.cascade(candidates, "id", {"gemini_text": 50}, vetoed)


@query("job_supplier_matching", """WITH w AS (SELECT d.id, len(w.words) > 0 AND len(list_filter(w.words, lambda x: contains(lower(d.source_url), x))) = 0 AS strange
  FROM v_doc d JOIN v_words w ON w.id = d.provider_id WHERE d.file_type <> 'manual')
SELECT 'matched' AS metric, count(*) AS rows FROM v_ledger_match WHERE provider_id IS NOT NULL UNION ALL SELECT 'unmatched', count(*) FROM v_ledger_match WHERE provider_id IS NULL
UNION ALL SELECT 'rejected', (SELECT count(*) FROM v_ledger_row) - (SELECT count(*) FROM v_ledger_match) UNION ALL SELECT 'foreign', count(*) FROM w WHERE strange""")
def _(v: Views) -> DataFrame:
    return table_metrics(jobs.supplier_matching(v.ledger_data, v.doc.drop("text"), v.provider, v.mix))


# Documents with labels, every third with a stored response; every fifth of those says that it is no label.
JOB_SQL = f"""WITH l AS ({LABEL_SQL}),
r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'gemini_vision' ELSE 'gemini_text' END AS method FROM documents WHERE doc_id % 3 = 0 AND doc_id % 15 <> 0
  AND (doc_id % 6 = 0 OR length(coalesce(text, '')) + CASE doc_id % 4 WHEN 2 THEN 0 WHEN 3 THEN 30 ELSE 200 END > 50)),
c AS (SELECT doc_id, method, CAST(2022 AS INT) AS year, 60.0::DOUBLE AS renewable, 30.0::DOUBLE AS fossil, 10.0::DOUBLE AS nuclear, CAST(50 + doc_id % 50 AS INT) AS confidence, 'T' || CAST(doc_id AS STRING) AS tariff_name, 'v' || CAST(doc_id % 2 AS STRING) AS prompt_version FROM r
  UNION ALL SELECT doc_id, 'regex', year, renewable, fossil, nuclear, CASE WHEN nuclear > 5 AND year >= 2024 THEN least(confidence, 30) ELSE confidence END, NULL, NULL FROM l WHERE doc_id NOT IN (SELECT doc_id FROM r)),
m AS (SELECT c.*, d.provider_id FROM c JOIN v_doc d ON d.id = c.doc_id JOIN v_provider p ON p.id = d.provider_id WHERE c.doc_id % 37 <> 5) """


def label_job(v: Views) -> dict[str, DataFrame]:
    key = F.col("id")
    printed = v.label_text.withColumnRenamed("doc_id", "id")
    written = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = key % 21 == 1  # some come as pages
    printed = printed.select("id", F.when(~page, F.col("text")).alias("text"), F.when(page, F.concat(F.lit('<p title="a > b">'), written)).alias("html"))
    docs = v.doc.drop("text").join(printed, "id")
    answer = F.concat(
        F.lit('{"is_skz": '), F.when(key % 15 == 0, "false").otherwise("true"), F.lit(', "year": 2022, "renewable": 60, "fossil": 30, "nuclear": 10, "confidence": '),
        (50 + key % 50).cast("string"), F.lit(', "tariff_name": "T'), key.cast("string"), F.lit('", "company_city": "Ort '), key.cast("string"),
        F.when(key % 2 == 0, '", "hkn_origins": [{"country": "Norwegen", "percentage": 60.5}, {"country": "Island", "percentage": 1}]}').otherwise('"}'))
    # the other documents' responses are no JSON and are refused, each with its reason
    answers = v.doc.select("id", F.when(key % 3 == 0, answer).otherwise("none").alias("raw_response"),
                           F.when(key % 6 == 0, "gemini_vision").alias("method"), F.concat(F.lit("v"), (key % 2).cast("string")).alias("prompt_version"))
    vetoes = v.doc.select("id", (key % 37 != 5).alias("is_label"), F.lit(90).alias("confidence"))
    return jobs.label_extraction(docs, answers, v.provider, v.trusted, 2023, vetoes, extracted_at=F.lit("2024-06-01 12:00:00").cast("timestamp"))


@query("job_label_extraction", JOB_SQL + "SELECT doc_id AS id, provider_id, year, renewable, fossil, nuclear, confidence, method AS extraction_method, tariff_name, prompt_version FROM m")
def _(v: Views) -> DataFrame:
    return label_job(v)["mixes"].select("id", "provider_id", "year", "renewable", "fossil", "nuclear", "confidence", "extraction_method", "tariff_name", "prompt_version")


@query("job_label_origins", JOB_SQL + """SELECT doc_id AS energy_mix_id, country, percentage FROM m, (VALUES ('Norwegen', 60.5::DOUBLE), ('Island', 1.0::DOUBLE)) o(country, percentage)
WHERE method <> 'regex' AND doc_id % 2 = 0""")
def _(v: Views) -> DataFrame:
    return label_job(v)["origins"]


@query("job_label_providers", JOB_SQL + """SELECT p.id, p.name, coalesce(e.city, p.city) AS city FROM v_provider p
LEFT JOIN (SELECT provider_id, 'Ort ' || CAST(max(doc_id) AS STRING) AS city FROM m WHERE method <> 'regex' GROUP BY 1) e ON e.provider_id = p.id""")
def _(v: Views) -> DataFrame:
    return label_job(v)["providers"].select("id", "name", "city")


@query("job_label_rejects", JOB_SQL + """SELECT id, 'supplier' AS reason FROM v_doc WHERE provider_id NOT IN (SELECT id FROM v_provider)
UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no_label' ELSE 'json' END FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 15 = 0""")
def _(v: Views) -> DataFrame:
    return label_job(v)["rejects"]


@query("job_label_documents", JOB_SQL + """SELECT d.id, d.provider_id, d.file_hash, m.prompt_version, m.method IS NOT NULL AND m.method <> 'regex' AS has_response,
  CASE WHEN m.doc_id IS NOT NULL THEN '2024-06-01 12:00:00' END AS ai_extracted_at FROM v_doc d LEFT JOIN m ON m.doc_id = d.id""")
def _(v: Views) -> DataFrame:
    return label_job(v)["documents"].select("id", "provider_id", "file_hash", "prompt_version", F.col("raw_response").isNotNull().alias("has_response"),
                                            stamp("ai_extracted_at"))


@query("job_label_outcomes", JOB_SQL + """SELECT d.id, d.provider_id, m.year, CASE WHEN p.id IS NULL THEN 'failed' WHEN m.year IS NULL THEN 'partial'
  WHEN len(w.words) > 0 AND len(list_filter(w.words, lambda x: contains(lower(d.source_url), x))) = 0 AND t.provider_id IS NULL THEN 'partial' ELSE 'success' END AS status
FROM v_doc d LEFT JOIN v_provider p ON p.id = d.provider_id LEFT JOIN v_words w ON w.id = d.provider_id LEFT JOIN m ON m.doc_id = d.id
LEFT JOIN v_trusted t ON t.provider_id = d.provider_id AND t.domain = 'host' || CAST(d.id % 13 AS STRING) || '.de'""")
def _(v: Views) -> DataFrame:
    return label_job(v)["outcomes"]


@query("job_source_selection", f"""WITH k AS ({RANK_SQL}) SELECT provider_id, url, score, position, url IN (SELECT url FROM k WHERE position % 2 = 0) AS offered FROM k
QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY score DESC, position) = 1""")
def _(v: Views) -> DataFrame:
    """Result lists, and pages behind the addresses that stand at even positions."""
    decoded = links.rank_search_results(v.result)
    offer = F.concat(F.lit('<base href="https://x.de/"><a href="'), F.col("position").cast("string"), F.lit('/Strommix.pdf">Strommix</a>'))
    pages = decoded.filter("position % 2 = 0").groupBy("url").agg(F.min("position").alias("position")).select(
        F.col("position").alias("page_id"), "url", offer.alias("html"))
    found = jobs.source_selection(v.result, pages)
    return found.select("provider_id", "url", "score", "position", F.coalesce(F.col("document_url").startswith("https://x.de/"), F.lit(False)).alias("offered"))


# --- files, printed lists, exports ------------------------------------------------------------------


@query("s3_manifest", """SELECT id AS prefix, kind AS file_type, h AS file_hash, bytes, id || '_' || kind || '_' || left(h, 8) || '.' || ext AS file_name,
  'data/storage/' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/2024/' || id || '_' || kind || '_' || left(h, 8) || '.' || ext AS file_path, bytes <= 20971520 AS accepted
FROM (SELECT d.id, p.name, sha256(blob) AS h, octet_length(blob) AS bytes, CASE d.id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' ELSE 'html' END AS kind, CASE d.id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' ELSE 'html' END AS ext
  FROM (SELECT id, provider_id, CASE id % 5 WHEN 0 THEN unhex('255044462D') WHEN 1 THEN unhex('89504E47') WHEN 2 THEN unhex('FFD8FF') ELSE encode('<p>') END || encode(text) AS blob FROM v_doc) d JOIN v_provider p ON p.id = d.provider_id)""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    head = (F.when(key % 5 == 0, F.unhex(F.lit("255044462D"))).when(key % 5 == 1, F.unhex(F.lit("89504E47")))
            .when(key % 5 == 2, F.unhex(F.lit("FFD8FF"))).otherwise(F.lit("<p>").cast("binary")))
    master = v.provider.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    files = v.doc.select(key.alias("prefix"), "provider_id", F.concat(head, F.col("text").cast("binary")).alias("content")).join(master, "provider_id")
    return manifest.manifest(files, F.lit(2024)).drop("provider_id", "provider_name")


@query("s4_printed_list", """SELECT page, line, name, address, zip, city FROM (SELECT page, floor(y * 10 + 0.5) / 10 AS line,
  arg_min(trim(text), seq) FILTER (x > 3 AND x < 10) AS name, arg_min(trim(text), seq) FILTER (x > 24 AND x < 30) AS address,
  arg_min(trim(text), seq) FILTER (x > 35 AND x < 38) AS zip, arg_min(trim(text), seq) FILTER (x > 39 AND x < 48) AS city
  FROM v_token GROUP BY 1, 2) WHERE length(name) > 2 AND name NOT LIKE '%Stand%' AND name NOT LIKE '%Liste der%'""")
def _(v: Views) -> DataFrame:
    return tokens.suppliers(v.token)


_NUM = "rtrim(rtrim(CAST({0} AS STRING), '0'), '.')"


@query("s5_csv_lines", f"""SELECT id, concat_ws(';', CAST(id AS STRING), '"' || CASE WHEN regexp_matches(name, '^[=+\\-@]') THEN '''' ELSE '' END || replace(name, '"', '""') || '"', '"' || replace(city, '"', '""') || '"', '', coalesce(file_number, ''), CAST(priority AS STRING),
  CASE WHEN active THEN 'Ja' ELSE 'Nein' END, coalesce(CAST(last_mix_year AS STRING), ''), coalesce({_NUM.format('last_renewable_percentage')}, ''), coalesce({_NUM.format('last_fossil_percentage')}, ''), coalesce({_NUM.format('last_nuclear_percentage')}, ''),
  coalesce({_NUM.format('co2_emission_g_kwh')}, ''), coalesce(CAST(last_confidence AS STRING), ''), coalesce(last_extraction_method, ''),
  CASE latest_job_status WHEN 'success' THEN 'Erfolgreich' WHEN 'failed' THEN 'Fehlgeschlagen' WHEN 'running' THEN 'Laufend' WHEN 'partial' THEN 'Teilweise' ELSE 'Nie gescrapt' END,
  CASE review_status WHEN 'geprueft' THEN 'Geprüft' WHEN 'beanstandet' THEN 'Beanstandet' ELSE 'Offen' END, CAST(document_count AS STRING)) AS line
FROM (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN '=' || name WHEN id % 6 = 1 THEN name || ' "x"' ELSE name END AS name) FROM v_snapshot)""")
def _(v: Views) -> DataFrame:
    key = F.col("id")
    odd = F.when(key % 6 == 0, F.concat(F.lit("="), "name")).when(key % 6 == 1, F.concat("name", F.lit(' "x"'))).otherwise(F.col("name"))
    return sinks.csv_lines(snapshot(v).withColumn("name", odd))


@query("s6_report_rows", f"""SELECT id, name, city, coalesce(CAST(last_mix_year AS STRING), '-') AS year, coalesce({_NUM.format('last_renewable_percentage')}, '0') || '%' AS renewable,
  coalesce({_NUM.format('co2_emission_g_kwh')}, '-') || ' g/kWh' AS co2, CASE review_status WHEN 'geprueft' THEN 'Geprüft' WHEN 'beanstandet' THEN 'Beanstandet' ELSE 'Offen' END AS review FROM v_snapshot""")
def _(v: Views) -> DataFrame:
    return sinks.report(snapshot(v))[1]


@query("s6_report_figures", "SELECT count(*) AS providers, CAST(floor(avg(CAST(coalesce(last_renewable_percentage, 0) AS DOUBLE)) + 0.5) AS BIGINT) AS mean_renewable FROM v_snapshot")
def _(v: Views) -> DataFrame:
    return sinks.report(snapshot(v))[0]


@query("s7_json", """SELECT CAST(to_json({'id': id, 'name': name, 'file_number': file_number, 'active': active}) AS STRING) AS value FROM v_provider""")
def _(v: Views) -> DataFrame:
    return sinks.json_lines(v.provider, ["id", "name", "file_number", "active"])


# --- monitoring -------------------------------------------------------------------------------------


@query("r1_rate_limit", """WITH RECURSIVE e AS (SELECT CAST(user_id AS STRING) AS key, epoch_us(ts) // 1000 AS t, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT key, min(t) AS t FROM e GROUP BY key UNION ALL SELECT e.key, min(e.t) FROM s JOIN e ON e.key = s.key AND e.t > s.t + 21600000 GROUP BY e.key),
a AS (SELECT e.key, e.t, e.n, max(s.t) AS w FROM e JOIN s ON s.key = e.key AND s.t <= e.t GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key, w ORDER BY t) - n AS BIGINT) AS before FROM a)
SELECT key, t AS at_ms, n AS requests, w AS window_ms, greatest(0, least(n, 2 - before)) AS allowed, n - greatest(0, least(n, 2 - before)) AS denied,
  CASE WHEN n > greatest(0, least(n, 2 - before)) THEN CAST(ceil((w + 21600000 - t) / 1000) AS BIGINT) END AS retry_after FROM c""")
def _(v: Views) -> DataFrame:
    return ratelimit.audit(v.event, "user_id", "ts", limit=2, window_ms=6 * 3600 * 1000)


def event_jobs(v: Views) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "signup", "running").when(kind == "purchase", "success").otherwise("partial")
    return v.event.select(F.col("event_id").alias("id"), F.col("user_id").alias("provider_id"), status.alias("status"),
                          F.col("ts").alias("started_at"), F.lit(None).cast("string").alias("log_message"))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'success' ELSE 'partial' END"


@query("r2_live_status", f"""SELECT user_id AS provider_id, count(*) FILTER (event_type = 'signup') AS running, count(*) FILTER (event_type = 'purchase') AS success,
  count(*) FILTER (event_type = 'error') AS failed, arg_max({_STATUS}, event_id) AS newest_status FROM events GROUP BY user_id""")
def _(v: Views) -> DataFrame:
    return monitor.live_status(event_jobs(v))


@query("r2_daily_counts", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_STATUS} AS status, count(*) AS jobs FROM events GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return monitor.daily_counts(event_jobs(v)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("r3_stale_jobs", f"""SELECT event_id AS id, CASE WHEN stale THEN 'failed' ELSE s END AS status, CASE WHEN stale THEN 'Timeout nach 2 Min.' END AS log_message
FROM (SELECT event_id, {_STATUS} AS s, event_type = 'signup' AND date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-20 00:00:00') > 120 AS stale FROM events)""")
def _(v: Views) -> DataFrame:
    return monitor.fail_stale(event_jobs(v), F.lit("2024-01-20 00:00:00")).select("id", "status", "log_message")
