"""Joins between suppliers, jobs, documents, mixes and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.names import match_key
from labelspark.functions.plan import settle
from labelspark.functions.urls import domain
from labelspark.stage import Stages


def fan_out(left: DataFrame, right: DataFrame, key: str, keys: DataFrame | None = None,
            present: DataFrame | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` where one key of ``right`` may hold a large share of all its rows.

    ``key`` is unique and never NULL in ``left``.  In a left outer join adaptive execution can only split a hot key of the
    left side.  So the keys without a match are first added to the many-rows side, which makes the rest an
    inner join whose hot key can be split.  ``keys`` and ``present`` give the keys of ``left`` and ``right``
    where they are cheaper to get than from these.
    """
    left_keys, right_keys = (left if keys is None else keys), (right if present is None else present)
    bare = left_keys.select(key).join(right_keys.select(key).distinct(), key, "left_anti")
    return right.unionByName(bare, allowMissingColumns=True).join(left, key)


def jobs_with_provider(jobs: DataFrame, providers: DataFrame, keep_orphans: bool = False) -> DataFrame:
    """Jobs with the supplier name; orphan jobs are kept on request."""
    names = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    return jobs.join(names, "provider_id", "left" if keep_orphans else "inner")


def with_year_volume(providers: DataFrame, deliveries: DataFrame, year: int) -> DataFrame:
    """All suppliers, with the delivered volume of one year where there is one."""
    volume = deliveries.filter(F.col("year") == year).select(F.col("provider_id").alias("id"), "delivered_volume_mwh")
    return providers.join(volume, "id", "left")


def year_star(providers: DataFrame, deliveries: DataFrame, documents: DataFrame, mixes: DataFrame,
              audits: DataFrame, year: int, latest_only: bool = False, totals: DataFrame | None = None) -> DataFrame:
    """Active suppliers with volume, label and verdict of one year.

    A supplier with two labels in the year appears twice.  ``latest_only`` keeps its newest document
    and mix instead.  The right sides are cut to the year before they are joined; those with one row per
    supplier (volume, verdict, ``totals``) come first, the labels last, so that a supplier with very many
    documents is met only once.
    """
    active = providers.filter("active").select(
        F.col("id").alias("provider_id"), F.col("name").alias("provider_name"), "file_number")
    volume = deliveries.filter(F.col("year") == year).select("provider_id", "delivered_volume_mwh")
    docs = documents.filter((F.col("reporting_year") == year) & (F.col("file_type") == "pdf")).select(
        F.col("id").alias("document_id"), "provider_id")
    columns = ["renewable_percentage", "hkn_percentage", "eeg_percentage"]
    shares = mixes.filter(F.col("document_id").isNotNull()).select(
        "document_id", F.col("id").alias("mix_id"), *[c for c in columns if c in mixes.columns])
    labels = fan_out(docs, shares, "document_id")
    if latest_only:
        from labelspark.operators.latest import pick
        rest = [c for c in labels.columns if c != "provider_id"]
        labels = pick(labels, "provider_id", F.struct("document_id", "mix_id"), rest)
    verdict = audits.filter(F.col("year") == year).drop("year").withColumnRenamed("status", "audit_status")
    base = active.join(volume, "provider_id", "left").join(verdict, "provider_id", "left")
    if totals is not None:
        base = base.join(totals, "provider_id", "left")
    return fan_out(base, labels, "provider_id", keys=active, present=docs)


def documents_with_mixes(documents: DataFrame, mixes: DataFrame) -> DataFrame:
    """Every document with its 0..n mixes."""
    right = mixes.select(F.col("document_id").alias("id"), F.col("id").alias("mix_id"), F.col("year").alias("mix_year"),
                         *[c for c in mixes.columns if c not in ("id", "document_id", "year", "provider_id", "created_at")])
    return fan_out(documents, right, "id")


def exists_flag(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """EXISTS as a column: keys are made distinct first, so rows never multiply."""
    keys = right.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def shared_hash_documents(documents: DataFrame) -> DataFrame:
    """Scraped documents whose content another supplier holds too."""
    from labelspark.operators.latest import hash_owners, shared_hashes

    shared = shared_hashes(hash_owners(documents))
    return documents.filter(F.col("file_type") != "manual").join(shared, "file_hash", "left_semi")


def orphan_mixes(mixes: DataFrame, documents: DataFrame) -> DataFrame:
    """Mixes whose document is gone."""
    known = documents.select(F.col("id").alias("document_id"))
    return mixes.filter(F.col("document_id").isNotNull()).join(known, "document_id", "left_anti")


def near_documents(mixes: DataFrame, documents: DataFrame, seconds: int = C.PROXIMITY_SECONDS) -> DataFrame:
    """Document-less mixes created less than ``seconds`` from some document of the same supplier.

    No pairs are built.  Time is cut into buckets of that width; per supplier and bucket only the
    first and last document time matter: a document in the same bucket is always near, the previous
    bucket is near when its last one is, the next bucket when its first one is.
    """
    width = seconds * 1000
    millis = F.unix_millis(F.col("created_at").cast("timestamp"))
    bounds = (
        documents.filter(F.col("created_at").isNotNull() & F.col("provider_id").isNotNull())
        .select("provider_id", millis.alias("_t"))
        .groupBy("provider_id", F.floor(F.col("_t") / width).alias("_bucket"))
        .agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    )
    # each bucket is announced to its neighbours, then reduced again to one row per bucket
    reach = (
        bounds.select(
            "provider_id",
            F.explode(F.array(
                F.struct((F.col("_bucket") - 1).alias("b"), F.lit(None).cast("long").alias("after"),
                         F.col("_first").alias("before"), F.lit(False).alias("same")),
                F.struct(F.col("_bucket").alias("b"), F.lit(None).cast("long").alias("after"),
                         F.lit(None).cast("long").alias("before"), F.lit(True).alias("same")),
                F.struct((F.col("_bucket") + 1).alias("b"), F.col("_last").alias("after"),
                         F.lit(None).cast("long").alias("before"), F.lit(False).alias("same")),
            )).alias("r"))
        .groupBy("provider_id", F.col("r.b").alias("_bucket"))
        .agg(F.max("r.after").alias("_prev"), F.min("r.before").alias("_next"), F.bool_or("r.same").alias("_same"))
    )
    loose = mixes.filter(F.col("document_id").isNull()).withColumn("_t", millis).withColumn(
        "_bucket", F.floor(F.col("_t") / width))
    near = F.col("_same") | F.coalesce(F.col("_t") - F.col("_prev") < width, F.lit(False)) | F.coalesce(
        F.col("_next") - F.col("_t") < width, F.lit(False))
    return loose.join(reach, ["provider_id", "_bucket"]).filter(near).drop("_t", "_bucket", "_prev", "_next", "_same")


def brand_priority(name: Column, tiers: dict[int, list[str]] = C.BRAND_TIERS) -> Column:
    """The highest tier of which a brand occurs in the name, else NULL (case matters).

    The tiers are a fixed list, so this is one projection rather than a join.
    """
    out = F.lit(None).cast("int")
    for priority in sorted(tiers):
        hit = reduce(lambda a, b: a | b, [name.contains(brand) for brand in tiers[priority]])
        out = F.when(hit, F.lit(priority)).otherwise(out)
    return out


def apply_brand_tiers(providers: DataFrame, tiers: dict[int, list[str]] = C.BRAND_TIERS) -> DataFrame:
    """Active suppliers get the priority of their tier; all others keep theirs."""
    new = F.when(F.col("active"), brand_priority(F.col("name"), tiers))
    return providers.withColumn("priority", F.coalesce(new, F.col("priority")))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, none of a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))))


def _runs(names: DataFrame, filed: DataFrame, stages: Stages, head: int = 3) -> DataFrame:
    """(id, name, _run): the runs of a name that start with the first characters of a run of ``filed`` and are as long as that
    one, each once per name.  Runs shorter than ``head`` are their own first characters."""
    heads = filed.select(F.substring("_run", 1, head).alias("_head"), F.length("_run").alias("_size"))
    heads = stages.write(heads.groupBy("_head").agg(F.collect_set("_size").alias("_sizes")), "heads")
    lengths = [r[0] for r in heads.select(F.length("_head")).distinct().collect()]  # head at most
    # a table of names may be one small file: the work on it is dealt out first
    spots = names.filter(F.length("name") > 0).select("id", "name").repartition("id").select(
        "id", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("_at"))
    starts = F.array_distinct(F.array(*[F.substring("name", F.col("_at"), F.lit(n)) for n in lengths]).cast("array<string>"))
    sized = spots.select("*", F.explode(starts).alias("_head")).join(heads, "_head").select(
        "id", "name", "_at", F.explode("_sizes").alias("_size")).filter(F.col("_at") + F.col("_size") - 1 <= F.length("name"))
    # a run that a name holds twice is asked for where it occurs first
    return sized.withColumn("_run", F.substring("name", F.col("_at"), F.col("_size"))).filter(
        F.position("_run", "name") == F.col("_at")).select("id", "name", "_run")


def brand_matches(names: DataFrame, brands: DataFrame, gram: int = 32, stages: Stages | None = None) -> DataFrame:
    """(id, brand, priority): the brands of a table that occur in a name (case matters).

    ``names``: id, name.  ``brands``: brand, priority; of a repeated brand the highest priority counts, null and empty ones
    are no brands.  A brand of up to ``gram`` characters is filed whole, a longer one under its run of ``gram`` characters that
    occurs in the fewest names.  Names ask with those of their runs that begin like a brand and are as long: an equi join gives the
    matches, for long brands candidates of which ``contains`` decides.  Short runs would not do: they are few, and
    the names and the brands that share one both grow with the tables.
    """
    stages = stages or Stages(names.sparkSession)
    known = brands.filter(F.coalesce(F.length("brand"), F.lit(0)) > 0).groupBy("brand").agg(F.max("priority").alias("priority"))
    known = stages.write(known, "brands")
    longest = known.agg(F.max(F.length("brand"))).first()[0]
    if longest is None:
        return names.select("id", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("priority")).limit(0)
    whole = known.filter(F.length("brand") <= gram).withColumn("_run", F.col("brand"))
    found = _runs(names, whole, stages).join(whole, "_run").select("id", "brand", "priority")
    if longest <= gram:
        return found
    filed = known.filter(F.length("brand") > gram).select("*", F.explode(_grams(F.col("brand"), gram)).alias("_run"))
    asked = _runs(names, filed, stages)
    # how many names hold a run; only runs of brands are counted
    wanted = asked.join(filed.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count(F.lit(1)).alias("_names"))
    wanted = stages.write(wanted, "runs")
    rank = F.struct(F.coalesce("_names", F.lit(0)), "_run")
    index = filed.join(wanted, "_run", "left").groupBy("brand", "priority").agg(F.min(rank).alias("_rarest"))
    index = stages.write(index.select("brand", "priority", F.col("_rarest._run").alias("_run")), "index")
    return found.unionByName(asked.join(index, "_run").filter(F.col("name").contains(F.col("brand"))).select("id", "brand", "priority"))


def apply_brand_table(providers: DataFrame, brands: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Active suppliers get the highest priority of the table's brands in their name; all others keep theirs."""
    stages = stages or Stages(providers.sparkSession)
    found = brand_matches(providers.filter("active").select("id", "name"), brands, stages=stages)
    best = stages.write(found.groupBy("id").agg(F.max("priority").cast("int").alias("_best")), "tiers")
    return providers.join(best, "id", "left").withColumn("priority", F.coalesce("_best", "priority")).drop("_best")


def match_ledger(lines: DataFrame, providers: DataFrame) -> DataFrame:
    """Ledger lines with the supplier whose normalised name is equal, NULL when there is none.

    When several suppliers share a key the smallest id wins.
    """
    keys = providers.groupBy(match_key(F.col("name")).alias("_key")).agg(F.min("id").alias("provider_id"))
    # settled, so that the join's null check does not evaluate the key a second time
    return settle(lines, {"_key": match_key(F.col("anbieter_name"))}).join(keys, "_key", "left").drop("_key")


def trusted_flag(rows: DataFrame, trusted: DataFrame, url: str = "source_url") -> DataFrame:
    """Is (supplier, domain of the source) on the list of confirmed sources?"""
    known = trusted.select("provider_id", F.col("domain").alias("_domain")).distinct().withColumn("trusted", F.lit(True))
    return (
        rows.withColumn("_domain", domain(F.col(url)))
        .join(known, ["provider_id", "_domain"], "left")
        .withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        .drop("_domain")
    )


def with_national_mix(mixes: DataFrame, year: str = "year", table: dict[int, tuple] = C.NATIONAL_MIX,
                      fallback: int = C.NATIONAL_FALLBACK_YEAR) -> DataFrame:
    """National shares of the year, or of the fallback year.  The table is a fixed four-row list, so the
    lookup is a projection."""
    names = ("national_renewable", "national_fossil", "national_nuclear", "national_co2")
    out = {}
    for i, name in enumerate(names):
        value = F.lit(float(table[fallback][i]))
        for known, row in table.items():
            value = F.when(F.col(year) == known, F.lit(float(row[i]))).otherwise(value)
        out[name] = value
    return mixes.withColumns(out)


def with_constants(rows: DataFrame, constants: DataFrame, fallback: int, year: str = "year") -> DataFrame:
    """Constants of the year from a table keyed by year, else those of the fallback year.

    The key is settled first (known year or fallback), then one equi join adds the constants.  Of a
    repeated year an arbitrary row counts (the smallest by value, so that runs agree).  Whether a side is broadcast is left to
    Spark's size check.
    """
    values = [c for c in constants.columns if c != "year"]
    unique = constants.filter(F.col("year").isNotNull()).groupBy("year").agg(F.min(F.struct(*values)).alias("_row"))
    known = unique.select(F.col("year").alias("_known"))
    keyed = rows.join(known, F.col(year) == F.col("_known"), "left").withColumn(
        "_year", F.coalesce("_known", F.lit(fallback))).drop("_known")
    return keyed.join(unique.select(F.col("year").alias("_year"), "_row.*"), "_year", "left").drop("_year")


def nest_cancellations(providers: DataFrame, cancellations: DataFrame, year: int) -> DataFrame:
    """Per supplier the list of (country, amount) of one year, empty when there is none.

    Amounts are reduced to one entry per country first (the key of the table), so a list is never
    longer than the number of countries.
    """
    lists = (
        cancellations.filter(F.col("year") == year)
        .groupBy("provider_id", "country").agg(F.sum("amount_mwh").alias("amount_mwh"))
        .groupBy("provider_id")
        .agg(F.sort_array(F.collect_list(F.struct("country", "amount_mwh"))).alias("cancellations"))
    )
    out = providers.join(lists.withColumnRenamed("provider_id", "id"), "id", "left")
    return out.withColumn("cancellations", F.coalesce(
        "cancellations", F.array().cast("array<struct<country:string,amount_mwh:decimal(25,2)>>")))


def nest_origins(mixes: DataFrame, origins: DataFrame) -> DataFrame:
    """Per mix the list of origins, largest share first, NULL when there is none.

    Equal (country, share) rows are counted rather than repeated while they travel, and expanded in the list.
    """
    lists = (
        origins.groupBy("energy_mix_id", "country", "percentage").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("energy_mix_id")
        .agg(F.collect_list(F.struct((-F.col("percentage")).alias("_o"), "country", "percentage", "_n")).alias("_l"))
        .select(
            F.col("energy_mix_id").alias("id"),
            F.flatten(F.transform(
                F.array_sort("_l"),
                lambda x: F.array_repeat(F.struct(x["country"].alias("country"), x["percentage"].alias("percentage")),
                                         x["_n"].cast("int")))).alias("hkn_origins"))
    )
    return mixes.join(lists, "id", "left")
