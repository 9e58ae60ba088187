import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    """The contract in plain integers."""
    docs = defaultdict(list)
    for _, text, lang, source in rows:
        docs[lang or ""].append((source or "", Counter(TERM.findall((text or "").translate(LOWER)))))
    out = set()
    for lang, own in docs.items():
        held = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in held.items() if n >= least)
        counts, whole = defaultdict(Counter), Counter()
        for source, c in own:
            counts[source].update({t: n for t, n in c.items() if held[t] >= least})
            whole.update({t: n for t, n in c.items() if held[t] >= least})

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for a in p:
            pairs = [(b, sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in p if b != a]
            terms = [(t, (p[a][t] - q[t]) ** 2 // q[t]) for t in kept if counts[a][t] and p[a][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "term", "place", "total", "value", "rank", "part", "item", "shard", "last"):
        df = df.selectExpr("*", f"'x' AS {name}")
    got = divergence.source_divergence(df, **options).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def texts(seed, n=300, sources=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = int(min(rng.integers(sources), rng.integers(sources)))
        words = rng.zipf(1.4, int(rng.integers(0, 60))) % 90 + (source % 3)
        rows.append((i, " ".join(f"Wort{chr(97 + w % 26)}{chr(97 + w // 26)}, " for w in words), ["de", "en"][i % 2], f"s{source}"))
    return rows


ODD = [(1, None, "de", "s1"), (2, "", None, None), (3, "Ähre ähre ÄHRE straße STRASSE İx İx", "", ""), (4, "Ähre\x00ähre\x7f1a2b", None, ""),
       (5, "one one one", "x", "only"), (None, "Ähre and Straße", "", None), (6, "...!!!", "de", "silent"), (7, "lone", "solo", "a"),
       (8, "lone", "solo", "b"), (9, "big " * 300_000 + "\U0001F600 end", "de", "s0"), (9, "same row", "de", "s0"), (9, "same row", "de", "s0"),
       (10, "\n \t", "nothing", "a"), (11, None, "nothing", "b"), (12, "same same row", "de", "é"), (13, "z", "de", "z'\""), (14, "big", "de", "Z")]


def test_equals_plain_integers(spark):
    rows = texts(1) + ODD
    assert found(spark, rows) == plain(rows)


def test_shards_blocks_and_tops(spark, monkeypatch):
    """Many shards, blocks of two sources and small matrices."""
    monkeypatch.setattr(divergence, "SHARD_ROWS", 60)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "CELLS", 40)
    rows = texts(2) + ODD
    assert found(spark, rows, top=5) == plain(rows, top=5)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_no_kept_terms(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y")]
    assert found(spark, rows) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


@pytest.mark.parametrize("total", [1, 3, 10**9 + 7, 9 * 10**13])
def test_shares_are_exact(spark, total):
    counts = [n for n in (0, 1, 2, total // 3, total // 2, total - 1) if n < total]
    want = [1 + 10**9 * (n + 1) // total for n in counts]
    assert divergence.share(np.array(counts, np.int64), np.int64(total)).tolist() == want
    df = spark.createDataFrame([(n, total) for n in counts], "n long, total long")
    assert [r[0] for r in df.select(divergence._share(df["n"], df["total"])).collect()] == want
