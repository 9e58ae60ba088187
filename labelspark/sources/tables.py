"""Domain tables with fixed schemas, and ad-hoc SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SHARES = ", ".join(
    f"{n}_percentage decimal(5,2)" for n in (
        "renewable", "fossil", "nuclear", "wind", "solar", "biomass", "hydro", "other_renewable", "coal", "natural_gas",
        "other_fossil", "eeg_funded", "hkn", "mieterstrom", "eeg"))

SCHEMAS: dict[str, str] = {
    "provider": "id long, name string, url string, skz_url string, address string, zip string, city string, "
                "file_number string, priority int, review_status string, active boolean, created_at timestamp, "
                "updated_at timestamp",
    "job": "id long, provider_id long, status string, started_at timestamp, finished_at timestamp, log_message string",
    "document": "id long, job_id long, provider_id long, file_type string, file_path string, file_hash string, "
                "source_url string, original_filename string, reporting_year int, raw_prompt string, "
                "raw_response string, model_name string, prompt_version string, ai_extracted_at timestamp, "
                "created_at timestamp",
    "mix": f"id long, document_id long, provider_id long, year int, {_SHARES}, co2_emission_g_kwh decimal(6,2), "
           "radioactive_waste_mg_kwh decimal(10,4), tariff_name string, confidence int, extraction_method string, "
           "mix_type string, raw_prompt string, raw_response string, model_name string, prompt_version string, "
           "validation_warnings array<struct<code:string,path:string,message:string,severity:string>>, "
           "source_status string, created_at timestamp",
    "origin": "id long, energy_mix_id long, country string, percentage decimal(5,2)",
    "delivery": "provider_id long, year int, delivered_volume_mwh decimal(15,2)",
    "cancellation": "provider_id long, year int, country string, amount_mwh decimal(15,2)",
    "audit_verdict": "provider_id long, year int, status string, hkn_deviation_percent decimal(8,2), audit_note string, "
                     "audited_by string, audited_at timestamp",
    "audit_log": "id long, action string, entity_type string, entity_id long, provider_id long, old_value string, "
                 "new_value string, description string, created_at timestamp",
    "note": "id long, provider_id long, text string, created_at timestamp, updated_at timestamp",
    "trusted_source": "provider_id long, domain string",
    "federal_constants": "year int, eeg_percentage decimal(5,2), renewable_percentage decimal(5,2), "
                         "fossil_percentage decimal(5,2), nuclear_percentage decimal(5,2), "
                         "co2_emission_g_kwh decimal(6,2), radioactive_waste_mg_kwh decimal(10,4)",
}


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A domain table; the schema is stated, never inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{folder}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[int, int], partitions: int, key: str = "id",
              properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational database, read in ``partitions`` ranges of its key between the two ``bounds``."""
    if bounds[0] >= bounds[1] or partitions < 2:
        raise ValueError("state the range of the key and two partitions or more")
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=partitions, properties=properties or {})


# How the tables are stored for joins without a shuffle: by the key that their rows are asked for.
STORED_BY = {
    "provider": "id", "job": "provider_id", "mix": "provider_id", "document": "provider_id", "delivery": "provider_id",
    "cancellation": "provider_id", "audit_verdict": "provider_id", "mix_by_document": "document_id", "document_by_id": "id",
}


def store(df: DataFrame, table: str, folder: str, buckets: int, key: str | None = None) -> DataFrame:
    """Store a table in ``buckets`` files by its key (see ``STORED_BY``), each sorted, and read it back.

    Tables stored by the same key with the same number of buckets are joined and grouped by it where they lie.  All rows of a
    key are in one bucket: choose buckets so that one fits a task, and keep a table with a key of a large share of all rows (or of nulls) in
    plain files, where adaptive execution can split it.  ``table`` is a name of the session's catalog; an existing one is replaced.
    """
    key = key or STORED_BY[table]
    rows = df.repartition(buckets, key)  # the buckets' own hash, so that every task writes one file
    rows.write.format("parquet").mode("overwrite").option("path", f"{folder}/{table}").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def adhoc(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """Run a statement over the given tables; each is written ``{name}`` in the text."""
    return spark.sql(statement, **tables)
