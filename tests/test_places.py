import random

import pytest
from pyspark.sql import functions as F

from labelspark.operators import paging, places
from labelspark.stage import Stages


def table(spark, n=1000):
    rng = random.Random(2)
    # a third of all rows share one value, some have none, ids repeat
    rows = [(i // 2, 7 if i % 3 == 0 else rng.choice([None, *range(40)]), f"t{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, value int, text string").repartition(5)


def sorted_rows(rows, descending=False):
    given = [r for r in rows if r[1] is not None]
    return sorted(given, key=lambda r: (-r[1] if descending else r[1], r[0])) + sorted((r for r in rows if r[1] is None), key=lambda r: r[0])


@pytest.mark.parametrize("descending", [False, True])
def test_every_row_has_its_place(spark, descending):
    rows, df = table(spark)
    with Stages(spark) as stages:
        got = places.placed(df, paging.user_order("value", descending), stages).rows().orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(rows) + 1))
    assert [(r.value, r.id) for r in got] == [(r[1], r[0]) for r in sorted_rows(rows, descending)]
    assert sorted(r.text for r in got) == sorted(r[2] for r in rows)


def test_pages_at_any_depth(spark):
    rows, df = table(spark, 230)
    want = [(r[1], r[0]) for r in sorted_rows(rows)]
    found = places.placed(df, paging.user_order("value"))
    assert found.pages(25) == 10 and found.pages(1000) == 1
    for number in (1, 5, 10, 11):
        got = found.page(number, 25).orderBy("place").collect()
        assert [(r.value, r.id) for r in got] == want[25 * (number - 1):25 * number]
        assert [r.place for r in got] == list(range(25 * (number - 1) + 1, 25 * (number - 1) + 1 + len(got)))
    # the last page reads no more than the first: its positions reach the scan
    plan = found.page(10, 25)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_position" in plan and "LessThanOrEqual(_position" in plan


def test_no_rows(spark):
    found = places.placed(spark.createDataFrame([], "id long, value int"), paging.user_order("value"))
    assert found.rows().count() == 0 and found.pages(10) == 1 and found.page(1, 10).count() == 0


def test_equal_rows_do_not_gather(spark):
    """Rows that are equal in the whole order spread over several partitions."""
    df = spark.range(20_000).select(F.lit(1).alias("id"), F.lit(1).alias("value"), F.repeat(F.lit("x"), 100).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = places.placed(df, paging.user_order("value"))
        sizes = [r._rows for r in found._bases.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 12_000
    assert sorted(r.place for r in found.rows().select("place").collect()) == list(range(1, 20_001))


def test_stages_delete_their_tables(spark):
    from pathlib import Path

    with Stages(spark) as stages:
        df = stages.write(spark.range(5), "numbers")
        assert df.count() == 5 and Path(stages.paths[0]).exists()
        path = stages.paths[0]
    assert not Path(path).exists()
