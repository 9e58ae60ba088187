"""Latest rows, joins, paging and keyed maintenance against plain Python."""

import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from labelspark.operators import filters, joins, latest, merge, paging


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_latest_row_per_key_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 50), i, rng.choice(["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "provider_id int, id int, status string").repartition(7)
    want = {}
    for p, i, s in rows:
        want[p] = (i, s)
    got = {r.provider_id: (r.latest, r.status) for r in latest.pick(df.withColumn("latest", F.col("id")), "provider_id", "id", ["latest", "status"]).collect()}
    assert got == want  # a NULL in the newest row stays NULL


def test_duplicate_flag_asymmetry(spark):
    docs = spark.createDataFrame([
        (1, "h", "pdf"), (2, "h", "manual"),          # 1 is flagged, 2 (only manual) is not
        (3, "g", "pdf"), (3, "g", "pdf"),             # same supplier twice is no duplicate
        (4, None, "pdf"), (5, None, "pdf"), (6, "x", "manual"), (7, "x", "manual")],
        "provider_id int, file_hash string, file_type string")
    got = {r.provider_id: (r.document_count, r.has_duplicate_doc) for r in latest.document_facts(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (2, False), 4: (1, False), 5: (1, False), 6: (1, False), 7: (1, False)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 400)), max_size=25), st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400)), max_size=25))
def test_near_documents_equals_pairwise(spark, mixes, docs):
    def frame(rows, extra):
        df = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(rows)], "id int, provider_id int, s int")
        return df.select("id", "provider_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("created_at"), *extra)

    got = {r.id for r in joins.near_documents(frame(mixes, [F.lit(None).cast("int").alias("document_id")]), frame(docs, [])).collect()}
    assert got == {i for i, (p, s) in enumerate(mixes) if any(p == q and abs(s - t) < 60 for q, t in docs)}


def test_paging_walks_the_whole_table(spark):
    rows = [(i, (i * 7) % 5 if i % 6 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v int")
    for descending in (False, True):
        want = [r.id for r in paging.sort_by(df, "v", descending).collect()]
        present = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0]))
        assert want == [r[0] for r in present] + [r[0] for r in rows if r[1] is None]
        pages, last = [], None
        while True:
            got = paging.page_after(df, "v", descending, 7, *(last or (None, None))).collect()
            if not got:
                break
            pages += [r.id for r in got]
            last = (got[-1].v, got[-1].id)
        assert pages == want
        order = [paging.sort_key("v", descending), F.col("id").asc()]
        assert [r.id for r in paging.page(df, order, 2, 7).collect()] == want[7:14]
    assert tuple(paging.page_count(df.limit(0), 7).first()) == (0, 1)
    assert tuple(paging.page_count(df, 7).first()) == (40, 6)


def test_locale_sort(spark):
    df = spark.createDataFrame([(1, "Zebra"), (2, "Äpfel"), (3, "apfel"), (4, None)], "id int, name string")
    assert [r.id for r in paging.sort_by(df, "name", collation="de").collect()] == [3, 2, 1, 4]


def test_null_priorities_come_first(spark):
    df = spark.createDataFrame([(1, 50), (2, None), (3, 90), (4, 90)], "id int, priority int")
    assert [r.id for r in paging.by_priority(df).collect()] == [2, 3, 4, 1]


def test_search_treats_nulls_as_empty(spark):
    df = spark.createDataFrame([(1, "Süd AG", None, "12"), (2, None, "Leipzig", None), (3, None, None, None)], "id int, name string, city string, zip string")
    assert rows_of(filters.search(df, "LEIP"), "id") == [(2,)]
    assert rows_of(filters.search(df, "12"), "id") == [(1,)]
    assert rows_of(filters.search(df, ""), "id") == [(1,), (2,), (3,)]


def test_brand_tiers(spark):
    df = spark.createDataFrame([(1, "E.ON Energie", 50, True), (2, "Stadtwerke Leipzig EWE", 50, True), (3, "Stadtwerke Jena", 50, False),
                                (4, "Stadtwerke Ulm/Neu-Ulm", None, True), (5, "eon", 55, True)], "id int, name string, priority int, active boolean")
    assert rows_of(joins.apply_brand_tiers(df), "id", "priority") == [(1, 100), (2, 100), (3, 50), (4, 70), (5, 55)]


def test_upsert_is_idempotent_and_last_writer_wins(spark):
    base = spark.createDataFrame([(1, 2021, "a", "keep"), (2, 2021, "b", "keep")], "p int, y int, v string, other string")
    updates = spark.createDataFrame([(1, 2021, "x", 1), (1, 2021, None, 2), (3, 2022, "n", 1)], "p int, y int, v string, o int")
    once = merge.upsert(base, updates, ["p", "y"], "o")
    want = [(1, 2021, None, "keep"), (2, 2021, "b", "keep"), (3, 2022, "n", None)]
    assert rows_of(once, "p", "y", "v", "other") == sorted(want, key=repr)
    assert rows_of(merge.upsert(once, updates, ["p", "y"], "o"), "p", "y", "v", "other") == sorted(want, key=repr)


def tables(spark):
    return {
        "provider": spark.createDataFrame([(1, "Alpha"), (2, "Stand 2024")], "id long, name string"),
        "job": spark.createDataFrame([(1, 1), (2, 2)], "id long, provider_id long"),
        "document": spark.createDataFrame([(10, 1, 0), (20, 2, 0)], "id long, provider_id long, s int").select(
            "id", "provider_id", F.timestamp_seconds("s").alias("created_at")),
        "mix": spark.createDataFrame([(100, 10, 1, 0), (200, 20, 2, 0), (201, 20, 1, 0), (300, None, 1, 30), (301, None, 1, 90)],
                                     "id long, document_id long, provider_id long, s int").select(
            "id", "document_id", "provider_id", F.timestamp_seconds("s").alias("created_at")),
        "origin": spark.createDataFrame([(1, 100), (2, 200), (3, 201), (4, 300)], "id long, energy_mix_id long"),
    }


def test_cascades_leave_no_orphans(spark):
    out = merge.delete_garbage(tables(spark))
    assert rows_of(out["provider"], "id") == [(1,)] and rows_of(out["document"], "id") == [(10,)]
    assert rows_of(out["mix"], "id") == [(100,), (300,), (301,)]  # 201 hung on a deleted document
    assert rows_of(out["origin"], "id") == [(1,), (4,)]
    assert joins.orphan_mixes(out["mix"], out["document"]).count() == 0
    out = merge.delete_documents(tables(spark), spark.createDataFrame([(10,)], "id long"))
    assert rows_of(out["mix"], "id") == [(200,), (201,), (301,)]  # 300 was created within a minute
    assert rows_of(out["origin"], "id") == [(2,), (3,)]


def test_replace_children(spark):
    base = spark.createDataFrame([(1, 2021, "NO", 5.0), (1, 2020, "NO", 5.0), (2, 2021, "SE", 1.0)], "provider_id int, year int, country string, amount_mwh double")
    new = spark.createDataFrame([(1, 2021, " IS ", 3.0, 1), (1, 2021, "IS", 4.0, 2), (1, 2021, "", 9.0, 3), (1, 2021, "FI", 0.0, 4)],
                                "provider_id int, year int, country string, amount_mwh double, o int")
    got = merge.replace_children(base, new, ["provider_id", "year"], order="o")
    assert rows_of(got, "provider_id", "year", "country", "amount_mwh") == [(1, 2020, "NO", 5.0), (1, 2021, "IS", 4.0), (2, 2021, "SE", 1.0)]
    origins = spark.createDataFrame([(1, "NO"), (2, "SE")], "energy_mix_id int, country string")
    assert rows_of(merge.replace_origins(origins, spark.createDataFrame([(1, "FI")], "energy_mix_id int, country string")), "energy_mix_id", "country") == [(1, "FI"), (2, "SE")]


def test_change_audit(spark):
    schema = "id int, name string, priority int, review_status string"
    old = spark.createDataFrame([(1, "A", 50, None), (2, "B", 50, "offen"), (3, "C", None, None)], schema)
    new = spark.createDataFrame([(1, "A", 60, "geprueft"), (2, "B", 50, "offen"), (4, "D", None, None)], schema)
    got = merge.change_audit(old, new)
    assert rows_of(got, "entity_id", "action", "field", "old_value", "new_value", "description", "old_json", "new_json") == [
        (1, "review_change", "Prüfstatus", None, "geprueft", "Prüfstatus geändert: - → geprueft", '{"Prüfstatus":null}', '{"Prüfstatus":"geprueft"}'),
        (1, "update", "Priorität", "50", "60", "Priorität geändert: 50 → 60", '{"Priorität":50}', '{"Priorität":60}')]


def test_ingest_rules(spark):
    old = spark.createDataFrame([(1, 1, "a")], "id int, provider_id int, file_hash string")
    new = spark.createDataFrame([(2, 1, "a"), (3, 2, "a"), (4, 2, "b"), (5, 2, "b"), (6, 3, "b")], "id int, provider_id int, file_hash string")
    fresh, resolved = merge.ingest_documents(old, new, "provider")
    assert rows_of(fresh, "id") == [(3,), (4,), (6,)]
    assert rows_of(resolved, "id", "resolved_id") == [(2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    fresh, resolved = merge.ingest_documents(old, new, "global")
    assert rows_of(fresh, "id") == [(4,)]
    assert rows_of(resolved, "id", "resolved_id") == [(2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]


def test_nested_lists(spark):
    providers = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    cancelled = spark.createDataFrame([(1, 2021, "SE", "1"), (1, 2021, "NO", "2"), (1, 2020, "FI", "3")], "provider_id int, year int, country string, a string").withColumn(
        "amount_mwh", F.col("a").cast("decimal(15,2)"))
    got = {r.id: [(c.country, float(c.amount_mwh)) for c in r.cancellations] for r in joins.nest_cancellations(providers, cancelled, 2021).collect()}
    assert got == {1: [("NO", 2.0), ("SE", 1.0)], 2: []}
    origins = spark.createDataFrame([(1, "NO", 10.0), (1, "SE", 60.0), (1, "SE", 60.0)], "energy_mix_id int, country string, percentage double")
    got = {r.id: r.hkn_origins and [(o.country, o.percentage) for o in r.hkn_origins] for r in joins.nest_origins(providers, origins).collect()}
    assert got == {1: [("SE", 60.0), ("SE", 60.0), ("NO", 10.0)], 2: None}


def test_fan_out_is_a_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10)] * 50 + [(2, None), (9, 1), (None, 7)], "k int, w int")
    assert rows_of(joins.fan_out(left, right, "k"), "k", "v", "w").count((1, "a", 10)) == 50
    got = rows_of(joins.fan_out(left.filter("k IS NOT NULL"), right, "k"), "k", "v", "w")
    assert got == rows_of(left.filter("k IS NOT NULL").join(right, "k", "left"), "k", "v", "w")


def test_small_updates_leave_the_base_where_it_is(spark):
    from labelspark.operators.merge import upsert

    base = spark.range(5_000_000).selectExpr("id AS provider_id", "2021 AS year", "cast(id AS decimal(15,2)) AS volume", "'x' AS note")
    new = spark.sql("SELECT * FROM VALUES (7L, 2021, 1), (7L, 2022, 2), (-3L, 2021, 3) AS t(provider_id, year, volume)")
    merged = upsert(base, new, ["provider_id", "year"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # the base meets broadcast updates twice; what is sorted are only updates and the keys they share with it
    assert re.search("BroadcastHashJoin .*LeftOuter", plan) and re.search("BroadcastHashJoin .*LeftSemi", plan)
    assert "FullOuter" not in plan and plan.count("SortMergeJoin") <= 1
    assert merged.count() == 5_000_002
    rows = {(r.provider_id, r.year): (int(r.volume), r.note) for r in merged.filter("provider_id in (7, 8, -3)").collect()}
    assert rows == {(7, 2021): (1, "x"), (8, 2021): (8, "x"), (7, 2022): (2, None), (-3, 2021): (3, None)}


def test_constants_of_any_year(spark):
    from labelspark.operators.joins import with_constants

    constants = spark.createDataFrame([(1999, 1), (2023, 2), (2023, 1), (3000, 5), (None, 9)], "year int, v int")
    rows = spark.createDataFrame([(1999,), (2023,), (3000,), (1,), (None,)], "year int")
    assert sorted(((r.year, r.v) for r in with_constants(rows, constants, 2023).collect()), key=repr) == sorted(
        [(1999, 1), (2023, 1), (3000, 5), (1, 1), (None, 1)], key=repr)


def test_foreign_jobs_keep_the_whole_address(spark):
    long = "https://foreign.de/" + "a" * 300
    jobs = spark.createDataFrame([(1, "success", "ok"), (2, "running", None), (3, "partial", "old")], "id long, status string, log_message string")
    plan = spark.createDataFrame([(10, 1, long, "delete"), (11, 2, long, "delete"), (12, 3, long, "ok")], "id long, job_id long, source_url string, action string")
    once = merge.apply_foreign_plan(jobs, plan)
    got = {r.id: (r.status, r.foreign_url) for r in once.collect()}
    assert got == {1: ("failed", long), 2: ("running", None), 3: ("partial", None)}
    assert {r.id: r.foreign_url for r in merge.apply_foreign_plan(once, plan).collect()} == {1: long, 2: None, 3: None}
    assert once.where("id = 1").first().log_message.endswith(long[:150] + ")")


def test_brand_table(spark):
    import random

    from labelspark.operators import joins

    rng = random.Random(4)
    letters = "abAB ä#1"
    names = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (902, "xyzxyz")]
    brands = [("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))), rng.randrange(100)) for _ in range(400)]
    brands += [("", 999), (None, 999), ("xyzx", 5), ("xyz", 7), ("zx", 9), ("nirgends", 999), ("xyz", 3)]
    df = spark.createDataFrame([(i, n, i % 5 != 0, i % 7) for i, n in names], "id long, name string, active boolean, priority int")
    table = spark.createDataFrame(brands, "brand string, priority int")
    got = {r.id: r.priority for r in joins.apply_brand_table(df, table).collect()}
    hits = {i: [p for b, p in brands if b and n and b in n] for i, n in names}
    assert got == {i: max(hits[i]) if i % 5 and hits[i] else i % 7 for i, _ in names}
    found = {(r.id, r.brand): r.priority for r in joins.brand_matches(df, table).collect()}
    assert found == {(i, b): max(p for x, p in brands if x == b) for i, n in names for b, _ in brands if b and n and b in n}
    plan = joins.brand_matches(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = table.limit(0)
    assert joins.brand_matches(df, none).collect() == [] and joins.apply_brand_table(df, none).count() == len(names)


def test_brand_table_files_no_crowd_under_one_run(spark):
    from collections import Counter

    from labelspark.operators import joins
    from labelspark.stage import Stages

    class Kept(Stages):
        def write(self, df, name):
            self.tables = getattr(self, "tables", {}) | {name: super().write(df, name)}
            return self.tables[name]

    def candidates(n):
        names = spark.range(n).select("id", F.format_string("Kunde#%09d GmbH", "id").alias("name"))
        brands = spark.range(n).select(F.format_string("#%09d", "id").alias("brand"), F.lit(1).alias("priority"))
        stages = Kept(spark)
        assert joins.brand_matches(names, brands, stages=stages).count() == n
        # brands are filed under a run of their own or, where no such table is written, whole
        index = stages.tables.get("index", stages.tables["brands"])
        filed = Counter(r["_gram"] if "_gram" in index.columns else r["brand"] for r in index.collect())
        runs = [{r.name[i:i + k] for k in (3, 10) for i in range(len(r.name) - k + 1)} for r in names.collect()]
        return sum(filed[run] for found in runs for run in found)

    # the tables grow four times, and so do the brands that names are compared with
    assert candidates(2000) == 2000 and candidates(8000) == 8000


def test_brand_table_with_long_brands(spark):
    import random

    from labelspark.operators import joins

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("aB ä") for _ in range(n))
    names = [(i, text(rng.randrange(0, 40))) for i in range(200)] + [(900, None), (901, ""), (902, "aa" * 30), (903, "\U0001d4d0\U0001d4d1" * 3)]
    held = [n for _, n in names if n]
    brands = [text(rng.randrange(1, 5)) for _ in range(50)] + [n[i:i + k] for n in held for i, k in [(rng.randrange(len(n)), rng.randrange(1, 20))]]
    brands += [b + "x" for b in brands] + ["a" * 59, "a" * 60, "a" * 61, "\U0001d4d1\U0001d4d0\U0001d4d1", "\U0001d4d1", "", None]
    df = spark.createDataFrame(names, "id long, name string")
    rows = [(b, i % 100) for i, b in enumerate(brands)]
    want = sorted((i, b, max(p for x, p in rows if x == b)) for i, n in names for b in {b for b in brands if b} if n and b in n)
    table = spark.createDataFrame(rows, "brand string, priority int")
    for gram in (1, 2, 4, 32):
        assert sorted(tuple(r) for r in joins.brand_matches(df, table, gram).collect()) == want, gram


def test_large_upsert_computes_its_base_once(spark, monkeypatch):
    from labelspark.operators import merge
    base = spark.range(10).select(F.col("id"), F.col("id").alias("v"), F.lit("x").alias("other"))
    updates = spark.range(5, 15).select(F.col("id"), (F.col("id") * 100).alias("v"))
    want = rows_of(merge.upsert(base, updates, ["id"]), "id", "v", "other")
    monkeypatch.setattr(merge, "SMALL_UPDATES", 3)
    got = merge.upsert(base, updates, ["id"])
    assert rows_of(got, "id", "v", "other") == want and got.dtypes == base.dtypes
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 10") == 1


def test_upsert_computes_its_updates_once(spark):
    from labelspark.operators import merge

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    base = spark.range(50).select("id", F.lit("old").alias("v"))
    updates = spark.range(40, 60).mapInPandas(count, "id long").select("id", F.lit("new").alias("v"))
    got = merge.upsert(base, updates, ["id"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, "new" if i >= 40 else "old") for i in range(60)]
    assert seen.value == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" in plan and "SortMergeJoin" not in plan  # the base stays where it lies
