import hashlib
import zlib
from collections import Counter

from labelspark.llm import sharding


def jump(key, shards):
    state = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    now, ahead = -1, 0
    while ahead < shards:
        now = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((now + 1) * (2147483648.0 / ((state >> 33) + 1)))
    return now


def test_shards_and_slots(frame, words):
    rows = [(i, words(i, i % 30)) for i in range(600)] + [(None, None), (None, "x"), (5, "other"), (5, "other"), (-3, ""), (10**15, "ü" * 50_000)]
    rows += [(7, "copy")] * 40
    got = sharding.shard_rows(frame(rows)).collect()
    want = Counter((k, 8 + len((t or "").encode()), zlib.crc32((t or "").encode()), "key", jump(k, 24), jump(k, 25)) for k, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    for shard in range(24):
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert ids == sorted(ids)


def test_many_shards_and_empty(spark, frame):
    ids = spark.range(300)
    got = ids.select("id", sharding.jump_shard(ids["id"], 1).alias("one"), sharding.jump_shard(ids["id"], 777).alias("many")).collect()
    assert all(r.one == 0 and r.many == jump(r.id, 777) for r in got)
    assert sharding.shard_rows(frame([])).count() == 0


def test_documents_in_order(frame):
    rows = [(i % 50, f"text {i % 70}") for i in range(400)] + [(None, None)]
    df = frame(rows)
    out = sharding.shard_documents(df)
    got = [(r.shard, r.slot) for r in out.collect()]
    assert got == sorted(got) and len(set(got)) == len(rows)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)
