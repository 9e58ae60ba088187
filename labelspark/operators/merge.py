"""Keyed maintenance as set-level transforms: every function returns new DataFrames."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.plan import settle
from labelspark.functions.urls import domain, source_matches
from labelspark.operators.filters import changed, garbage_name
from labelspark.operators.joins import near_documents
from labelspark.operators.latest import last_writer, pick
from labelspark.stage import Stages


SMALL_UPDATES = 100_000  # rows that are worth a second look at the base's keys


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None, stages: Stages | None = None) -> DataFrame:
    """Insert new keys, replace the values of known keys.  With ``order`` the last update of a key wins.

    Columns of ``base`` that the updates do not carry keep their value.  The updates are computed once, into a table of
    ``stages``, so their size is known: where they are small enough for Spark to broadcast them, the base is neither shuffled nor
    sorted.  Known keys are replaced in a left join, and which updates are new is told by a semi join over the base's key columns.
    More than ``SMALL_UPDATES`` rows are merged in one full join instead, for which the base is computed once and not twice.
    """
    if order is not None:
        updates = last_writer(updates, keys, order)
    updates = (stages or Stages(base.sparkSession)).write(updates, "updates")
    values = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.struct(*values).alias("_new"))

    def merged(how: str) -> DataFrame:
        types = dict(base.dtypes)
        return base.join(new, keys, how).select(*[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in base.columns
        ])

    if updates.count() > SMALL_UPDATES:
        return merged("full")
    replaced = merged("left")
    known = base.select(*keys).join(updates.select(*keys), keys, "left_semi").distinct()
    types = dict(base.dtypes)
    fresh = updates.join(known, keys, "left_anti").select(*[
        (F.col(c) if c in updates.columns else F.lit(None)).cast(types[c]).alias(c) for c in base.columns])
    return replaced.unionByName(fresh)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else new.select(*keys).distinct()
    # the smallest row per key, so that a repeated task gives the same result
    fresh = one.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def replace_children(base: DataFrame, new: DataFrame, parent: list[str], parents: DataFrame | None = None,
                     order: str | None = None) -> DataFrame:
    """All cancellations of the given parents are replaced.  Countries are trimmed; empty countries and
    amounts of zero or less are dropped; of a repeated country the last amount counts."""
    touched = (new if parents is None else parents).select(*parent).distinct()
    clean = new.filter((F.coalesce("country", F.lit("")) != "") & (F.col("amount_mwh") > 0)).withColumn(
        "country", F.trim("country"))
    if order is not None:
        clean = last_writer(clean, [*parent, "country"], order)
    kept = base.join(touched, parent, "left_anti")
    return kept.unionByName(clean.select(*base.columns))


def replace_origins(origins: DataFrame, new: DataFrame) -> DataFrame:
    """The origins of every mix named in ``new`` are replaced."""
    kept = origins.join(new.select("energy_mix_id").distinct(), "energy_mix_id", "left_anti")
    return kept.unionByName(new.select(*origins.columns))


def delete_providers(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete suppliers and everything that hangs on them."""
    gone = ids.select(F.col("id").alias("provider_id")).distinct()
    out = dict(tables)
    out["provider"] = tables["provider"].join(gone.withColumnRenamed("provider_id", "id"), "id", "left_anti")
    for name in ("job", "note", "delivery", "cancellation", "audit"):
        if name in tables:
            out[name] = tables[name].join(gone, "provider_id", "left_anti")
    lost_docs = tables["document"].join(gone, "provider_id", "left_semi").select("id")
    out["mix"] = tables["mix"].join(gone, "provider_id", "left_anti")
    return _drop_documents(out, lost_docs)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete documents, their mixes, and document-less mixes of the same supplier created within a minute."""
    out = dict(tables)
    doomed = tables["document"].join(ids.select("id").distinct(), "id", "left_semi")
    if {"created_at"} <= set(doomed.columns) & set(tables["mix"].columns):
        near = near_documents(tables["mix"], doomed).select("id")
        out["mix"] = tables["mix"].join(near, "id", "left_anti")
    return _drop_documents(out, doomed.select("id"))


def _drop_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    out["document"] = tables["document"].join(ids, "id", "left_anti")
    out["mix"] = tables["mix"].join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    if "origin" in tables:
        kept = out["mix"].select(F.col("id").alias("energy_mix_id"))
        out["origin"] = tables["origin"].join(kept, "energy_mix_id", "left_semi")
    return out


def delete_garbage(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete suppliers whose name is header or footer text."""
    return delete_providers(tables, tables["provider"].filter(garbage_name(F.col("name"))).select("id"))


def abort_running(jobs: DataFrame, as_of: Column, suffix: str = C.ABORT_SUFFIX) -> DataFrame:
    """Running jobs end as failed; the reason is appended to their log."""
    running = F.col("status") == "running"
    ended = F.col("finished_at") if "finished_at" in jobs.columns else F.lit(None)
    return jobs.withColumns({
        "log_message": F.when(running, F.concat(F.coalesce("log_message", F.lit("")), F.lit(suffix))).otherwise(
            F.col("log_message")),
        "finished_at": F.when(running, as_of).otherwise(ended),
        "status": F.when(running, "failed").otherwise(F.col("status")),
    })


def backfill_provider(children: DataFrame, parents: DataFrame, link: str) -> DataFrame:
    """Missing supplier ids are taken from the linked parent row."""
    source = parents.select(F.col("id").alias(link), F.col("provider_id").alias("_p"))
    return children.join(source, link, "left").withColumn("provider_id", F.coalesce("provider_id", "_p")).drop("_p")


def backfill_year(documents: DataFrame, mixes: DataFrame) -> DataFrame:
    """Missing reporting years are taken from the document's mix with the smallest id."""
    years = pick(mixes.filter(F.col("document_id").isNotNull() & F.col("year").isNotNull()),
                 "document_id", "id", ["year"], newest=False)
    source = years.select(F.col("document_id").alias("id"), F.col("year").alias("_y"))
    return documents.join(source, "id", "left").withColumn("reporting_year", F.coalesce("reporting_year", "_y")).drop("_y")


def deactivate(providers: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        marks = ids.select("id").distinct().withColumn("_off", F.lit(True))
        marked = providers.join(marks, "id", "left")
        return marked.withColumn("active", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("active"))).drop("_off")
    return providers.withColumn("active", F.when(F.col("id").isin(ids), F.lit(False)).otherwise(F.col("active")))


def change_audit(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One audit row per changed field of the records present in both snapshots."""
    fields = [f for f in C.AUDIT_FIELDS if f in old.columns and f in new.columns]
    pairs = old.select(key, F.struct(*fields).alias("_old")).join(new.select(key, F.struct(*fields).alias("_new")), key)
    entries = []
    for field in fields:
        before, after = F.col(f"_old.{field}"), F.col(f"_new.{field}")
        label = C.AUDIT_FIELDS[field]
        shown = [F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-")) for c in (before, after)]
        entries.append(F.when(changed(before, after), F.struct(
            F.lit("review_change" if field == "review_status" else "update").alias("action"),
            F.lit(label).alias("field"),
            before.cast("string").alias("old_value"),
            after.cast("string").alias("new_value"),
            F.concat(F.lit(f"{label} geändert: "), shown[0], F.lit(" → "), shown[1]).alias("description"),
            F.to_json(F.struct(before.alias(label)), {"ignoreNullFields": "false"}).alias("old_json"),
            F.to_json(F.struct(after.alias(label)), {"ignoreNullFields": "false"}).alias("new_json"),
        )))
    found = F.filter(F.array(*entries), lambda x: x.isNotNull())
    settled = settle(pairs.select(F.col(key).alias("entity_id"), "_old", "_new"), {"_found": found})
    return settled.select("entity_id", F.explode("_found").alias("e")).select("entity_id", "e.*")


def enrich_master_data(providers: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted company data: the name only fills a missing or very short one; address, zip and city
    replace the stored value when given."""
    have = [f for f in ("name", "address", "zip", "city") if f"company_{f}" in extracted.columns and f in providers.columns]
    joined = providers.join(extracted.select("id", *[f"company_{f}" for f in have]), "id", "left")
    columns = {}
    for field in have:
        given = F.nullif(F.col(f"company_{field}"), F.lit(""))
        use = given.isNotNull()
        if field == "name":
            use = use & (F.col("name").isNull() | (F.length("name") < 3))
        columns[field] = F.when(use, given).otherwise(F.col(field))
    return joined.withColumns(columns).select(*providers.columns)


def ingest_documents(existing: DataFrame, new: DataFrame, scope: str = "provider", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Store new documents once.

    ``provider``: one document per (supplier, hash), as a scrape does; ``global``: one per hash, as an
    upload does.  Returns (documents to insert, every new document with the id it resolves to).
    """
    keys = ["provider_id", "file_hash"] if scope == "provider" else ["file_hash"]
    known = existing.groupBy(*keys).agg(F.min("id").alias("_known"))
    first = new.groupBy(*keys).agg(F.min(order).alias("_first"))
    resolved = new.join(first.join(known, keys, "left"), keys, "left")
    resolved = resolved.withColumn("resolved_id", F.coalesce("_known", "_first"))
    inserted = resolved.filter(F.col("_known").isNull() & (F.col(order) == F.col("_first")))
    return inserted.drop("_known", "_first", "resolved_id"), resolved.drop("_known", "_first")


def foreign_document_plan(documents: DataFrame, providers: DataFrame, mixes: DataFrame, keep: list[int] | None = None) -> DataFrame:
    """What to do with every scraped document that has a source: keep, delete, or leave alone because
    it is hand-edited or cannot be judged."""
    names = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    manual = (
        mixes.filter((F.col("extraction_method") == "manual") & F.col("document_id").isNotNull())
        .select(F.col("document_id").alias("id")).distinct().withColumn("_manual", F.lit(True))
    )
    rows = documents.filter((F.col("file_type") != "manual") & F.col("source_url").isNotNull()).join(names, "provider_id")
    rows = settle(rows.join(manual, "id", "left"), {"_m": source_matches(F.col("source_url"), F.col("provider_name"))})
    kept = F.col("id").isin(keep) if keep else F.lit(False)
    action = (
        F.when(kept, "keep")
        .when(F.col("_m").isNull(), "undecidable")
        .when(F.col("_m"), "ok")
        .when(F.col("_manual"), "foreign_manual")
        .otherwise("delete")
    )
    return rows.withColumn("action", action).drop("_m", "_manual")


def apply_foreign_plan(jobs: DataFrame, plan: DataFrame) -> DataFrame:
    """Jobs whose document is deleted count as failed, so that they run again.

    The message holds 150 characters of the document's address, the new column ``foreign_url`` all of it.
    """
    doomed = plan.filter((F.col("action") == "delete") & F.col("job_id").isNotNull())
    urls = doomed.groupBy(F.col("job_id").alias("id")).agg(F.min_by("source_url", F.struct("id")).alias("_url"))
    marked = jobs.join(urls, "id", "left")
    hit = F.col("_url").isNotNull() & F.col("status").isin("success", "partial")
    message = F.concat(F.lit("Bereinigt: Dokument stammte von fremdem Anbieter ("), F.substring("_url", 1, 150), F.lit(")"))
    return marked.withColumns({
        "log_message": F.when(hit, message).otherwise(F.col("log_message")),
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        # a job that was marked before keeps its address
        "foreign_url": F.when(hit, F.col("_url")).otherwise(F.col("foreign_url") if "foreign_url" in jobs.columns else F.lit(None)),
    }).drop("_url")


def load_manual_entries(entries: DataFrame) -> DataFrame:
    """Hand-made mixes: confidence 100 and method ``manual`` unless given; the mix type is not stored."""
    return entries.drop("mix_type").withColumns({
        "confidence": F.coalesce("confidence", F.lit(100)),
        "extraction_method": F.coalesce("extraction_method", F.lit("manual")),
    })


def mark_reviewed(providers: DataFrame, entries: DataFrame) -> DataFrame:
    """Suppliers with a new hand-made mix count as reviewed."""
    ids = entries.select(F.col("provider_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    marked = providers.join(ids, "id", "left")
    return marked.withColumn(
        "review_status", F.when(F.col("_done"), F.lit("geprueft")).otherwise(F.col("review_status"))).drop("_done")


def admit_new_names(providers: DataFrame, new: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """New suppliers whose name is not taken yet, ignoring case; the others are returned as rejects."""
    taken = providers.select(F.lower("name").alias("_n")).distinct().withColumn("_taken", F.lit(True))
    first = new.groupBy(F.lower("name").alias("_n")).agg(F.min(order).alias("_first"))
    rows = new.withColumn("_n", F.lower("name")).join(first.join(taken, "_n", "left"), "_n", "left")
    fresh = F.col("_taken").isNull() & (F.col(order) == F.col("_first"))
    marked = rows.withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    columns = new.columns
    return marked.filter("_fresh").select(*columns), marked.filter(~F.col("_fresh")).select(*columns)


def confirm_sources(mixes: DataFrame, documents: DataFrame, trusted: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirm the source of a set of mixes: their status changes and the domains join the trusted list."""
    wanted = ids.select("id").distinct()
    marks = wanted.withColumn("_ok", F.lit(True))
    confirmed = mixes.join(marks, "id", "left").withColumn(
        "source_status", F.when(F.col("_ok"), F.lit("bestaetigt")).otherwise(F.col("source_status"))).drop("_ok")
    urls = documents.select(F.col("id").alias("document_id"), "source_url")
    pairs = (
        mixes.join(wanted, "id", "left_semi").filter(F.col("document_id").isNotNull())
        .select("provider_id", "document_id").distinct()
        .join(urls, "document_id")
        .select("provider_id", domain(F.col("source_url")).alias("domain"))
        .filter(F.col("domain").isNotNull())
    )
    return confirmed, insert_if_absent(trusted, pairs, ["provider_id", "domain"])


