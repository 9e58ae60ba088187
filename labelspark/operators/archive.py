"""The archive of a supplier: stored documents with their mixes, and mixes without a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelspark.operators.joins import fan_out, nest_origins
from labelspark.operators.paging import union_all

# columns of a document and of a mix that keep their own name in the archive
_OWN = ("id", "provider_id", "document_id", "year", "created_at")


def archive(documents: DataFrame, mixes: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Every document with each of its mixes (mix columns NULL without one), then the mixes without a document.

    All columns of both tables are kept: of a mix ``mix_id``, ``mix_year`` and every other column under its name, where a
    document has none of that name (else ``mix_`` in front).  ``sort_year`` is the reporting year or the year of the mix;
    ``created_at`` that of the document, or of the mix where there is no document.  With ``origins`` (energy_mix_id, country,
    percentage) each row carries ``hkn_origins``.
    """
    if origins is not None:
        mixes = nest_origins(mixes, origins)
    taken = set(documents.columns) | set(_OWN)
    named = {"id": "mix_id", "year": "mix_year", "created_at": "mix_created_at"} | {
        c: f"mix_{c}" for c in mixes.columns if c not in _OWN and c in taken}
    renamed = mixes.withColumnsRenamed({k: v for k, v in named.items() if k in mixes.columns})
    attached = renamed.filter(F.col("document_id").isNotNull()).drop("provider_id").withColumnRenamed("document_id", "id")
    # a document may hold a large share of all mixes
    stored = fan_out(documents, attached, "id").withColumn("sort_year", F.coalesce("reporting_year", "mix_year"))
    loose = renamed.filter(F.col("document_id").isNull()).drop("document_id").withColumns(
        {"file_type": F.lit("manual"), "sort_year": F.col("mix_year"), "created_at": F.col("mix_created_at")})
    return union_all([stored, loose])
