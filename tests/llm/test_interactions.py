import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from labelspark.llm import interactions

WORD = re.compile("[^\x20\x09-\x0d]+")


def mask(text):
    words = WORD.findall(text)
    capitals = len(re.findall("[A-Z]", text))
    return {f for f, fails in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text),
                                           bool(re.search("[#$%&*|]", text))), strict=True) if fails}


def plain(rows, labels):
    """Every order applied to every document."""
    docs = []
    for key, text, lang in rows:
        text = text or ""
        fails = mask(text) | ({"E"} if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows) else set())
        own = [(q, t) for k, q, t in labels if k is not None and k == key]
        docs.append((lang or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in everyone) - len(gone)
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in everyone),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("mask", "part", "rank", "good", "toxic", "quality", "n", "text_key"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'x' AS good", "'x' AS lang")
    got = interactions.audit_filters(docs, marks).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_every_order_applied():
    """The core against plain orders, without Spark: the intervals of a mask cover each rank once."""
    for size in (1, 3, 5):
        rows = interactions.intervals(size)
        orders = list(permutations(range(size)))
        for m in range(1 << size):
            for rank, order in enumerate(orders):
                steps = {(s, f) for k, s, f, goes, a, b in rows if k == m and goes and a <= rank < b}
                first = next(((s, f) for s, f in enumerate(order, 1) if m >> f & 1), None)
                assert steps == ({first} if first else set())
        assert len(interactions.merged(rows)) <= len(rows)


def test_documents(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        n = int(rng.integers(150, 260))
        text = " ".join(f"w{x}" for x in rng.integers(0, int(rng.integers(20, 400)), n))
        text = text.upper() if rng.random() < 0.3 else text
        rows.append((i, text + (" 5%" if rng.random() < 0.3 else ""), [None, "", "de", "en"][i % 4]))
    rows += [(200 + i, rows[i][1], "de") for i in range(30)]  # copies, also from other languages
    rows += [(300, None, "en"), (301, "", "en"), (302, None, None), (None, rows[3][1], "en"), (None, None, "xx"), (5, rows[5][1], "en"),
             (400, "long word " * 120_000, "xx"), (401, "ÄÖ | \U0001F600", "xx"), (1, rows[40][1], "xx"), (402, " \t\n\x0b", "en")]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 240, 2)] + [(3, None, None), (None, 1, 1), (7, 0, 1), (7, 1, 0)]
    assert found(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, "a", "en")], []) == plain([(1, "a", "en")], [])


@pytest.mark.parametrize("text, want", [
    ("", {"A"}), ("w " * 200, {"B"}), (" ".join(f"w{i}" for i in range(200)), set()), ("A" * 3 + "b" * 97, {"A"}),
    ("A" * 4 + "b" * 96, {"A", "C"}), ("é" * 60 + "AA", {"A", "C"}), ("a|b", {"A", "D"}), ("\x0b \r", {"A"}),
])
def test_masks_at_their_limits(spark, text, want):
    from pyspark.sql import functions as F

    assert mask(text) == want
    got = spark.createDataFrame([(text,)], "text string").select(interactions.text_mask(F.col("text"))).first()[0]
    assert got == sum(1 << "ABCD".index(f) for f in want)
