"""Latest-state operators.

All "latest row" results come from partial aggregates (``max_by`` on a struct), so a supplier that
owns a third of all rows is reduced inside every map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

JOB_COLUMNS = ("status", "finished_at", "log_message")
MIX_COLUMNS = (
    "year", "renewable_percentage", "fossil_percentage", "nuclear_percentage", "co2_emission_g_kwh",
    "confidence", "extraction_method",
)
SNAPSHOT_MIX_NAMES = {
    "year": "last_mix_year",
    "renewable_percentage": "last_renewable_percentage",
    "fossil_percentage": "last_fossil_percentage",
    "nuclear_percentage": "last_nuclear_percentage",
    "co2_emission_g_kwh": "co2_emission_g_kwh",
    "confidence": "last_confidence",
    "extraction_method": "last_extraction_method",
}


def pick(df: DataFrame, keys: list[str] | str, order: Column | str, columns: list[str], newest: bool = True,
         extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key: the one with the greatest (or least) order value.

    ``order`` may be a struct to break ties.  ``extra`` aggregates ride on the same shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    choose = F.max_by if newest else F.min_by
    # NULL orders are ignored by max_by, so wrap: a struct is never NULL
    rank = F.struct(F.col(order) if isinstance(order, str) else order)
    picked = df.groupBy(*keys).agg(choose(F.struct(*columns), rank).alias("_row"), *extra)
    rest = [c for c in picked.columns if c not in keys and c != "_row"]
    return picked.select(*keys, "_row.*", *rest)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest job per supplier (three columns)."""
    have = [c for c in JOB_COLUMNS if c in jobs.columns]
    out = pick(jobs, "provider_id", "id", have)
    names = {"status": "latest_job_status", "finished_at": "latest_job_date", "log_message": "latest_job_log"}
    return out.withColumnsRenamed({k: v for k, v in names.items() if k in have})


def latest_mixes(mixes: DataFrame) -> DataFrame:
    """Newest mix per supplier (seven columns) and whether any of its mixes has an unconfirmed source."""
    flag = F.bool_or(F.coalesce(F.col("source_status") == "unbestaetigt", F.lit(False))).alias("has_unverified_source")
    return pick(mixes, "provider_id", "id", list(MIX_COLUMNS), extra=(flag,)).withColumnsRenamed(SNAPSHOT_MIX_NAMES)


def hash_owners(documents: DataFrame) -> DataFrame:
    """Documents reduced to one row per (hash, supplier): the base of all duplicate questions."""
    return documents.groupBy("file_hash", "provider_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.bool_or(F.coalesce(F.col("file_type") != "manual", F.lit(False))).alias("any_scraped"),
    )


def shared_hashes(owners: DataFrame) -> DataFrame:
    """Hashes held by more than one supplier.

    "More than one" is ``min < max``: two plain aggregates, where a distinct count would shuffle
    every owner of a hot hash into one place.
    """
    return (
        owners.filter(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(F.min("provider_id").alias("_lo"), F.max("provider_id").alias("_hi"))
        .filter(F.col("_lo") < F.col("_hi"))
        .select("file_hash")
    )


def document_facts(documents: DataFrame) -> DataFrame:
    """Per supplier: number of documents and whether a scraped document is also held by another supplier.

    The other holder may be a manual document; that asymmetry is intended.
    """
    owners = hash_owners(documents)
    shared = shared_hashes(owners).withColumn("_shared", F.lit(True))
    marked = owners.join(shared, "file_hash", "left")
    return marked.groupBy("provider_id").agg(
        F.sum("documents").alias("document_count"),
        F.bool_or(F.coalesce(F.col("_shared") & F.col("any_scraped"), F.lit(False))).alias("has_duplicate_doc"),
    )


def snapshot(providers: DataFrame, jobs: DataFrame, mixes: DataFrame, documents: DataFrame) -> DataFrame:
    """The supplier overview: master data, newest job, newest mix, flags and document count.

    Every fact table is aggregated to one row per supplier before it is joined.
    """
    parts = [latest_jobs(jobs), latest_mixes(mixes), document_facts(documents)]
    out = providers
    for part in parts:
        out = out.join(part.withColumnRenamed("provider_id", "id"), "id", "left")
    return out.withColumns({
        "has_unverified_source": F.coalesce("has_unverified_source", F.lit(False)),
        "has_duplicate_doc": F.coalesce("has_duplicate_doc", F.lit(False)),
        "document_count": F.coalesce("document_count", F.lit(0)),
    })


def last_writer(updates: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key: the last one in input order."""
    values = [c for c in updates.columns if c not in keys and c != order]
    return pick(updates, keys, order, values)


def best_candidate(candidates: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Highest score per group, the earliest position on ties."""
    order = F.struct(F.col("score"), (-F.col("position")).alias("p"))
    return pick(candidates, key, order, [url, "score", "position"])


def best_per_key(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its highest score and the position of its first occurrence."""
    return candidates.groupBy(*keys).agg(F.max("score").alias("score"), F.min("position").alias("position"))
