"""The user-level jobs, each one plan per result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.operators import links, merge, quality, text
from labelspark.operators.latest import best_candidate
from labelspark.sources import ledger, responses
from labelspark.stage import Results, Stages

FIGURES = [
    "renewable", "fossil", "nuclear", "solar", "wind", "hydro", "biomass", "other_renewable", "coal", "natural_gas",
    "other_fossil", "eeg_funded", "hkn", "mieterstrom", "co2", "waste", "eeg_percentage",
]
COMPANY = ["company_name", "company_address", "company_zip", "company_city"]
PROVENANCE = ["raw_prompt", "raw_response", "model_name", "prompt_version"]
# column -> type; a method that does not give one has NULL there
RESULT_COLUMNS = {
    "id": "long", "year": "int", "mix_type": "string", **{c: "double" for c in FIGURES}, "confidence": "int", "tariff_name": "string",
    **{c: "string" for c in [*COMPANY, *PROVENANCE]}, "hkn_origins": "array<struct<country:string,percentage:double>>",
}
# below these lengths a method's text is not worth reading
MINIMUM_LENGTH = {"gemini_text": 50, "ocr": 30}
RANKS = {"gemini_vision": 1, "gemini_text": 2, "ocr": 3, "regex": 4}


def _candidate(df: DataFrame, sizes: DataFrame, method: Column) -> DataFrame:
    """A method's results in common form, with the length of the document's text."""
    columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT_COLUMNS.items()]
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.col("method")]
    rows = df.select(*columns, method.alias("method"), F.lit(True).alias("found")).withColumn("rank", rank)
    return rows.join(sizes, "id")


def label_extraction(documents: DataFrame, raw_responses: DataFrame | None, providers: DataFrame, trusted: DataFrame,
                     default_year: int, vetoes: DataFrame | None = None, stored: DataFrame | None = None,
                     section_length: int | None = C.SECTION_LENGTH, extracted_at: Column | None = None,
                     stages: Stages | None = None) -> Results:
    """Documents and stored model responses to mixes.

    ``documents``: id, provider_id, file_hash, source_url, text; where there is an ``html``, the page's visible text stands
    in for a missing text.  ``raw_responses``: id, raw_response, and where known method (``gemini_vision`` goes before
    ``gemini_text``, the default, and both before the patterns), raw_prompt, model_name, prompt_version.  ``vetoes``: (id,
    is_label, confidence) of a classifier.  ``stored``: (id, provider_id, file_hash) of documents read before; a document of
    the same supplier and content is not read again.

    Returns ``mixes`` (accepted, with issues, provenance and source status), ``origins`` (their certificates' countries),
    ``providers`` (with company data filled in), ``documents`` (without texts; where a mix was accepted, with the prompt, response,
    model and prompt version behind it, NULL for the patterns, and ``ai_extracted_at``, the given ``extracted_at``), ``reused``
    (id, resolved_id), ``rejects`` (id, reason) and ``outcomes`` (one status per document that was read; documents of unknown
    suppliers have failed and are rejects).  Texts and responses are read once: what they gave is a table of ``stages``.
    """
    stages = stages or Stages(documents.sparkSession)
    if stored is not None:
        documents, resolved = merge.ingest_documents(stored, documents)
        reused = resolved.filter(F.col("id") != F.col("resolved_id")).select("id", "resolved_id")
    else:
        reused = documents.select("id", F.col("id").alias("resolved_id")).limit(0)
    printed = documents.select("id", "text", *[c for c in ("html",) if c in documents.columns])
    if "html" in printed.columns:
        seen = text.page_text(printed.filter("text is null and html is not null").select("id", "html"))
        printed = printed.filter("text is not null or html is null").select("id", "text").unionByName(seen)
    sizes = printed.select("id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_length"))
    found = text.extract_labels(printed, default_year, section_length=section_length)
    candidates = [_candidate(found, sizes, F.lit("regex"))]
    refused = None
    if raw_responses is not None:
        good, bad = responses.normalise(raw_responses)
        method = F.coalesce("method", F.lit("gemini_text")) if "method" in raw_responses.columns else F.lit("gemini_text")
        candidates.append(_candidate(good, sizes, method))
        refused = bad.select("id", F.col("reason"))
    rows = reduce(lambda a, b: a.unionByName(b), candidates)
    chosen = text.cascade(rows, "id", MINIMUM_LENGTH, vetoes).withColumnRenamed("method", "extraction_method")
    gated = stages.write(quality.ingest_gate(quality.with_issues(chosen)), "extracted")
    names = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"), F.lit(True).alias("_known"))
    sources = quality.guard_sources(documents.drop("text", "html").join(names, "provider_id", "left"), trusted)
    sources = stages.write(sources, "sources")
    known = sources.filter("_known")
    accepted = gated.filter("accepted").drop("accepted", "rank", "text_length")
    mixes = known.select("id", "provider_id", "source_status").join(accepted, "id")
    year = F.when(F.col("_known"), F.col("year"))
    outcomes = sources.join(mixes.select("id", "year"), "id", "left").select(
        "id", "provider_id", year.alias("year"), quality.job_outcome(year, F.col("_known").isNotNull(), F.col("source_unverified")).alias("status"))
    rejects = gated.filter(~F.col("accepted")).select("id", F.lit("sum").alias("reason")).unionByName(
        sources.filter("_known is null").select("id", F.lit("supplier").alias("reason")))
    if refused is not None:
        rejects = rejects.unionByName(refused)
    origins = mixes.select("id", F.explode("hkn_origins").alias("o")).select(F.col("id").alias("energy_mix_id"), "o.country", "o.percentage")
    # of several documents of a supplier the newest one's company data counts
    company = mixes.select("provider_id", "id", *COMPANY).filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in COMPANY]))
    company = company.groupBy(F.col("provider_id").alias("_provider")).agg(*[F.max_by(c, "id").alias(c) for c in COMPANY]).withColumnRenamed("_provider", "id")
    stamp = (F.lit(None) if extracted_at is None else extracted_at).cast("timestamp")
    behind = mixes.select("id", F.struct(*PROVENANCE, stamp.alias("ai_extracted_at")).alias("_behind"))
    plain = documents.drop("text", "html")
    given = {c: F.col(c) if c in plain.columns else F.lit(None).cast(t) for c, t in (*((c, "string") for c in PROVENANCE), ("ai_extracted_at", "timestamp"))}
    read = plain.join(behind, "id", "left").withColumns(
        {c: F.when(F.col("_behind").isNotNull(), F.col(f"_behind.{c}")).otherwise(own) for c, own in given.items()}).drop("_behind")
    return Results({
        "mixes": lambda: mixes.drop("hkn_origins", *COMPANY), "origins": lambda: origins,
        "providers": lambda: merge.enrich_master_data(providers, company), "documents": lambda: read,
        "reused": lambda: reused, "rejects": lambda: rejects, "outcomes": lambda: outcomes,
    })


def link_selection(pages: DataFrame) -> DataFrame:
    """The best label document of every page, from its markup."""
    return best_candidate(links.score_document_links(links.page_links(pages)), "page_id")


def source_selection(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The best address found for every supplier, and the best label document on the page behind it.

    ``results``: provider_id, position, url, query.  ``pages``: page_id, url, html of the pages that were loaded.
    """
    best = links.choose_source(results).select("provider_id", "url", "score", "position")
    offered = link_selection(pages).select("page_id", F.col("url").alias("document_url"), F.col("score").alias("document_score"))
    loaded = pages.select("page_id", "url").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return best.join(loaded, "url", "left").join(offered, "page_id", "left")


def supplier_matching(lines: DataFrame, documents: DataFrame, providers: DataFrame, mixes: DataFrame,
                      stages: Stages | None = None) -> dict[str, DataFrame]:
    """Ledger lines and documents against the suppliers: matched, unmatched and foreign.

    The lines are read and matched once, into a table of ``stages``.
    """
    stages = stages or Stages(lines.sparkSession)
    matched, rejected = ledger.read_matched(lines, providers, stages)
    matched = matched.drop("line", "reason")
    plan = merge.foreign_document_plan(documents, providers, mixes)
    return {
        "matched": matched.filter(F.col("provider_id").isNotNull()),
        "unmatched": matched.filter(F.col("provider_id").isNull()),
        "rejected": rejected,
        "foreign": plan.filter(F.col("action").isin("delete", "foreign_manual")),
    }
