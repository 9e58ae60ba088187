import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import embedding_dup

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component) by position, all pairs compared."""
    def unit(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, np.float32).astype(float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units, n, to = [unit(e) for _, e, _ in rows], [0] * len(rows), list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ b >= threshold:
                n[i] += 1
                n[j] += 1
                to[root(i)] = root(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted([(k, n[i], least.get(root(i))) for i, (k, _, _) in enumerate(rows)], key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "copies", "bucket", "valid", "vector", "root", "rows", "place"):
        df = df.selectExpr("*", f"'x' AS {name}")
    out = embedding_dup.embedding_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in out], key=repr)


def around(rng, centre, n, noise):
    x = centre + rng.standard_normal((n, len(centre))) * noise / np.sqrt(len(centre))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


def cloud(seed, dim=32):
    """Vectors around and beside the threshold, one large group, and every odd case."""
    rng = np.random.default_rng(seed)
    rows = [(i, v, int(i % 3)) for i, v in enumerate(rng.standard_normal((200, dim)).astype(np.float32).tolist())]
    for g in range(12):
        rows += [(1000 + 10 * g + i, v, g % 2) for i, v in enumerate(around(rng, rng.standard_normal(dim) / np.sqrt(dim), 6, 0.14))]
    centre = rng.standard_normal(dim) / np.sqrt(dim)
    rows += [(2000 + i, v, 1) for i, v in enumerate(around(rng, centre, 150, 0.14))]
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # copies
    rows += [(3100 + i, rows[5][1], 99) for i in range(3)] + [(3200, rows[5][1], None), (3201, rows[5][1], None)]
    rows += [(3300, [4 * x for x in rows[5][1]], rows[5][2]), (3301, [1e30 * x for x in rows[5][1]], rows[5][2]),
             (3302, [1e-30 * x for x in rows[5][1]], rows[5][2])]
    rows += [(4000, None, 0), (4001, [], 0), (4002, [0.0] * dim, 0), (4003, [0.0] * dim, 0), (4004, [None] + [1.0] * (dim - 1), 0),
             (4005, [float("nan")] * dim, 0), (4006, [float("inf")] * dim, 0), (4007, rows[5][1][:7], rows[5][2]), (4008, rows[5][1][:7], rows[5][2]),
             (4009, [1.0], 0), (4010, [2.0], 0), (4011, [-2.0], 0), (None, rows[5][1], rows[5][2]), (None, None, None),
             (None, [9.0, 1.0], 5), (None, [9.0, 1.0], 5), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    return rows


def test_groups_equal_all_pairs(spark):
    rows = cloud(1)
    assert found(spark, rows) == plain(rows)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(embedding_dup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dup, "CHUNK", 100)
    rows = cloud(2)
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_only_rows_without_a_vector(spark):
    assert found(spark, [(2, None, 1), (1, [0.0], 1)]) == [(1, 0, 1), (2, 0, 2)]


def test_share_of_cells_and_plan():
    rng = np.random.default_rng(4)
    for distance in (0.2, 1.0, 1.4):
        gap, shift = rng.standard_normal(400_000) * distance, rng.random(400_000) * embedding_dup.WIDTH
        seen = (np.floor((gap + shift) / embedding_dup.WIDTH) == 0).mean()
        assert seen == pytest.approx(embedding_dup.share(distance), abs=0.005)
    for n in (1, 10**4, 10**9):
        cells, tables = embedding_dup.table_plan(n)
        assert (1 - embedding_dup.share(0.2) ** cells) ** tables <= embedding_dup.MISS
        assert n * embedding_dup.share(2 ** 0.5) ** cells <= embedding_dup.STRAY


def test_pairs_at_the_threshold_are_met():
    """All of 3,000 random pairs of cosine 0.98 share a bucket; the chance of a miss is one in a million each."""
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    hasher = embedding_dup.Hasher(*embedding_dup.table_plan(6000))
    near = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    assert (hasher(a) == hasher(near)).any(axis=1).all()
    assert (hasher(a) == hasher(b)).sum() < 200  # strangers seldom


def test_unit_rows_of_mixed_lengths():
    column = pa.array([[3.0, 4.0], [1e200], [0.0, -2.0]], pa.list_(pa.float64()))
    got = {u.shape[1]: (at.tolist(), u.tolist()) for at, u in embedding_dup.unit_rows(column.slice(0))}
    assert got == {1: ([1], [[1.0]]), 2: ([0, 2], [[0.6, 0.8], [0.0, -1.0]])}
