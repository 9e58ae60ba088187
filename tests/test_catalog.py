"""Every registered query against its oracle on the smallest tables, and the shape of the plans."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import TABLES, table  # noqa: E402
from labelspark.plans import catalog  # noqa: E402
from labelspark.plans.views import Views  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(catalog.PLANS))
def test_query_equals_oracle(spark, oracle, name):
    df = catalog.PLANS[name](Views(spark, FOLDER))
    text = plan_text(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        cursor = oracle.execute(catalog.ORACLES[name])
        assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_printed_list_with_keys_of_six_digits(spark, tmp_path):
    """The printed zip is the last five digits of a supplier's number."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (c_custkey + 123450 AS c_custkey) FROM '{FOLDER}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT * FROM '{FOLDER}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.PLANS["s4_printed_list"](Views(spark, str(tmp_path)))
    cursor = con.execute(catalog.ORACLES["s4_printed_list"])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_scans_are_pruned_and_filters_pushed(spark):
    v = Views(spark, FOLDER)
    text = plan_text(catalog.PLANS["a2_status_distribution"](v))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", text)
    text = plan_text(v.provider.filter("id = 7").select("name"))
    assert "EqualTo(c_custkey,7)" in text


def test_facts_are_reduced_before_they_are_joined(spark):
    """The snapshot shuffles only partial aggregates of the fact tables: between a fact scan and the first
    exchange above it there is always an aggregate."""
    v = Views(spark, FOLDER)
    from labelspark.operators import latest
    for df in (latest.latest_jobs(v.job), latest.document_facts(v.doc)):
        above = plan_text(df).split("Scan parquet")[0]
        assert "partial_" in above.rsplit("Exchange", 1)[1]


def test_top_k_per_key_is_cut_before_the_shuffle(spark):
    text = plan_text(catalog.PLANS["t5_audit_trail"](Views(spark, FOLDER)))
    assert "WindowGroupLimit" in text.split("Exchange", 1)[1]
