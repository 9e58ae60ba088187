import re

import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import near_dup
from labelspark.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    """(n_shingles, component) by position, all pairs compared."""
    sets, to = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * len(a | sets[j]):
                to[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)]


def found(df):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()]


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.integers(len(w))] = f"e{rng.integers(10**9)}"
    return " ".join(w)


def test_groups_equal_all_pairs(frame, words):
    rng = np.random.default_rng(3)
    rows = [(i, words(i, int(rng.integers(1, 90)))) for i in range(40)]
    base = words(999, 120)
    rows += [(100 + i, edited(base, rng, int(rng.integers(0, 9)))) for i in range(130)]  # a large group around the threshold
    rows += [(300 + i, base) for i in range(50)]  # exact copies
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "ONE Two"), (405, "one two three"),
             (406, "é ü"), (None, base), (None, None), (3, rows[3][1]), (3, rows[3][1]), (5, words(777, 40)),
             (500, words(1234, 30_000)), (501, edited(words(1234, 30_000), rng, 40)), (502, "x" * 300_000)]
    assert sorted(found(frame(rows)), key=repr) == sorted(plain(rows), key=repr)


def test_large_buckets_in_blocks(frame, words, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK_WEIGHT", 5_000)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    rng = np.random.default_rng(5)
    base = words(5, 100)
    rows = [(i, edited(base, rng, int(rng.integers(0, 8)))) for i in range(120)]
    assert sorted(found(frame(rows))) == sorted(plain(rows))


def test_block_links_equal_all_pairs(words):
    """A block by itself, where every node is still alone."""
    rng = np.random.default_rng(8)
    base = words(8, 90)
    texts = [edited(base, rng, int(rng.integers(0, 7))) for _ in range(40)]
    (_, _, sets), = near_dup.shingle_sets(pa.array(texts))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sigs = near_dup.signatures(np.concatenate(sets), starts)
    n = len(texts)
    for second in (0, 1):  # one part, then two
        part = np.arange(n) % (second + 1)
        block = pa.table({
            "part": pa.array(part), "i": pa.array(np.zeros(n, int)), "j": pa.array(np.full(n, second)), "node": pa.array(np.arange(n)),
            "label": pa.array(np.arange(n)), "n": pa.array([len(s) for s in sets]), "common": pa.array([len(s) for s in sets]),
            "sig": pa.array([s.tobytes() for s in sigs]), "shingles": pa.array([s.view(np.int64).tolist() for s in sets])})
        got = {tuple(r.values()) for r in near_dup._block_links(block).to_pylist()}
        plain_sets = [shingles(t) for t in texts]
        want = {(a, b) for b in range(n) for a in range(b) if (second == 0 or part[a] != part[b])
                and 100 * len(plain_sets[a] & plain_sets[b]) >= 75 * len(plain_sets[a] | plain_sets[b])}
        assert got == want and want


def test_more_parts_than_nodes(frame, words, monkeypatch):
    """Parts of a bucket that no node is dealt to are empty sides of blocks."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK_WEIGHT", 200)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    rng, seen = np.random.default_rng(5), []
    cross = near_dup._cross_blocks
    monkeypatch.setattr(near_dup, "_cross_blocks", lambda rest, *more: seen.append(rest.count()) or cross(rest, *more))
    base = words(5, 100)
    rows = [(i, edited(base, rng, int(rng.integers(0, 8)))) for i in range(16)]
    assert sorted(found(frame(rows))) == sorted(plain(rows)) and seen[0] > 0


@pytest.mark.parametrize("filled", [0, 1])
def test_block_with_an_empty_part(words, filled):
    (_, _, sets), = near_dup.shingle_sets(pa.array([words(1, 90), words(1, 90)]))
    sigs = near_dup.signatures(np.concatenate(sets), np.array([0, len(sets[0])]))
    n = [len(s) for s in sets]
    block = pa.table({"part": [filled] * 2, "i": [0, 0], "j": [1, 1], "node": [0, 1], "label": [0, 1], "n": n, "common": n,
                      "sig": [s.tobytes() for s in sigs], "shingles": [s.view(np.int64).tolist() for s in sets]})
    links = near_dup._block_links(block)
    assert links.num_rows == 0 and links.schema == pa.schema({"a": pa.int64(), "b": pa.int64()})


def test_empty_table(frame):
    assert found(frame([])) == []


def test_one_of_each_group_stays(frame):
    rows = [(7, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, "other words are in here now"),
            (10, None), (11, ""), (None, "only null ids here today"), (None, "only null ids here today")]
    kept = near_dup.deduplicate(frame(rows))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(
        [(3, "a b c d e f g"), (9, "other words are in here now"), (10, None), (11, ""), (None, "only null ids here today")], key=repr)
    assert kept.columns == frame(rows).columns


@pytest.mark.parametrize("matches_of", [32, 64, 96, 128])
def test_bound_of_the_posterior(matches_of):
    floor = near_dup.keep_from(matches_of)
    assert 0 < floor < 0.75 * matches_of  # never above what the threshold promises


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 499), (499, 500)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
