import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import ann


def brute(rows, queries, most):
    usable = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((key, tuple(v)), np.array(v, np.float64))
    out = {}
    for (q, tq), a in usable.items():
        if q in queries:
            best = {}
            for (k, _), b in usable.items():
                if k != q and len(a) == len(b):
                    s = float(sum(x * y for x, y in zip(a, b)) / (np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(y * y for y in b))))
                    best[k] = max(s, best.get(k, -2))
            out[q] = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:most]
    return out


def found(spark, rows, keep, most=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS node", "1 AS shard", "'y' AS score", "2 AS ids")
    got = {}
    for r in ann.nearest(df, df.where(keep), most).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, want):
    return np.mean([len({k for k, _ in got.get(q, [])} & {k for k, _ in w}) / max(len(w), 1) for q, w in want.items() if w])


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] + [0.0] * 7) for i in range(40)]  # one vector of many rows
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (None, [1.0] * 8),
             (204, [float("inf")] + [1.0] * 7), (3, rows[3][1]), (100, [1.0] + [0.0] * 7), (205, [2.0] + [0.0] * 7)]
    got, want = found(spark, rows, "vec_id % 5 = 0 or vec_id is null"), brute(rows, {i for i in range(300) if i % 5 == 0}, 5)
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items()}
    assert all(abs(s - t) < 1e-12 for q in want for (_, s), (_, t) in zip(got[q], want[q]))


def test_vectors_of_different_length_never_meet(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 3).astype(np.float32).tolist()) for i in range(150)] + [(200, []), (201, [1.0]), (202, [-2.0]), (203, [5.0] * 90)]
    got, want = found(spark, rows, "vec_id % 4 = 0 or vec_id > 199"), brute(rows, {i for i in range(300) if i % 4 == 0 or i > 199}, 5)
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items() if v}


def test_the_visited_share_falls_as_a_shard_grows():
    """On the hardest vectors, without any structure, and on clustered ones (figures for large shards are in the README)."""
    def visited_share(vectors):
        n = len(vectors)
        graph = ann._build(pa.table({"width": pa.array([32] * n), "shard": pa.array([0] * n), "node": pa.array(np.arange(n)), "vector": pa.array(vectors.tolist())}))
        members, links = ([layer.values.to_numpy() for layer in graph.column(c)[0].values] for c in ("members", "links"))
        points = ann._rows(graph.column("vectors"), 32)
        asked = np.arange(0, n, n // 100)
        ids, _, visited = ann.search_shard(points, members, links, points[asked], 6)
        want = np.argsort(-(points[asked] @ points.T), axis=1)[:, :6]
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids.tolist(), want.tolist())]) >= 0.95
        return visited.mean() / n

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    for vectors in (rng.standard_normal((10_000, 32)), centres[rng.integers(0, 60, 10_000)] + 0.5 * rng.standard_normal((10_000, 32))):
        assert visited_share(vectors) < 0.65 * visited_share(vectors[:3_000])


def test_fewer_candidates_than_asked(spark):
    assert found(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id = 1") == {1: [(2, pytest.approx(2 ** -0.5))]}
    assert found(spark, [(1, [1.0, 0.0])], "true") == {} and found(spark, [], "true") == {}


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    data = (centres[rng.integers(0, 12, 4000)] + 0.7 * rng.normal(size=(4000, 32))).astype(np.float32)
    rows = list(enumerate(data.tolist()))
    got = found(spark, rows, "vec_id % 40 = 0")
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    hits = []
    for q in range(0, 4000, 40):
        s = unit @ unit[q]
        s[q] = -2
        hits.append(len({k for k, _ in got[q]} & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.95


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.select("vec_id", "embedding").toPandas()
    x = np.array(data.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(data.vec_id.to_numpy() % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hits.append(len(got[int(data.vec_id[i])] & set(data.vec_id[np.argsort(-s)[:5]].tolist())) / 5)
    assert np.mean(hits) >= 0.9
