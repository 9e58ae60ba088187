"""The pipeline against plain versions of its stages, each on its own input; oracles on the small tables."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

import corpus_pipeline  # noqa: E402
from check import TABLES, table  # noqa: E402
from labelspark.llm import toxicity  # noqa: E402
from labelspark.llm.queries import ORACLES, QUERIES  # noqa: E402
sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_decontaminate  # noqa: E402
import test_mixing  # noqa: E402
import test_near_dup  # noqa: E402
import test_sharding  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    pick = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    before = pick(docs)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = pick(docs)
    model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    toxic = {r.doc_id for r in model.score(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("toxicity_score >= 0.5").collect()}
    want = [r for r in before if r[0] not in toxic]
    assert Counter(seen["toxicity"]) == Counter(want) and toxic

    alike = test_near_dup.plain([r[:2] for r in want])
    want = [r for r, (key, _, component) in zip(want, alike) if component is None or key == component]
    assert Counter(seen["near_duplicates"]) == Counter(want)

    marks = {r[0]: r[5] for r in test_decontaminate.plain([r[:2] for r in want], items)}
    want = [r for r in want if not marks[r[0]]]
    assert Counter(seen["decontamination"]) == Counter(want) and any(marks.values())

    taken = {r[0]: r[4] // max(r[1], 1) for r in test_mixing.plain(want)[0]}
    held = Counter(r[0] for r in seen["mixing"])
    by_id = {r[0]: r for r in want}
    assert {k: v for k, v in held.items() if test_mixing.WORD.search(by_id[k][1] or "")} == {k: v for k, v in taken.items() if v}
    assert all(r == by_id[r[0]] for r in seen["mixing"])

    rows = docs.collect()
    assert Counter(seen["sharding"]) == Counter(seen["mixing"])
    assert all(r.shard == test_sharding.jump(r.doc_id, 24) for r in rows)
    for shard in range(24):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_run_keeps_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and rows.count() > 0
