import hashlib
import random
import re

import numpy as np

from labelspark.llm import decontaminate, wordhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items):
    windows = []
    for key, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        windows += [(key, w[i:i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for key, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, held = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    held.add(item)
        ids = sorted(str(i) for i in held if i is not None)
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(docs, items):
    return sorted([tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()], key=repr)


def test_counts_equal_the_plain_search(frame, words):
    rng = random.Random(4)
    passage = words(1, 60, 300)
    items = [(1, passage), (2, "The  SHORT one"), (3, "x"), (4, passage[:200]), (10, None), (11, ""), (None, "null id item here"),
             (5, words(2, 13)), (6, words(3, 12)), (7, "é à ü " * 9), (1, passage), (9, "same word " * 30)]
    docs = [(i, words(i + 50, rng.randrange(0, 120), 30)) for i in range(30)]
    p = passage.split()
    for i in range(25):  # cut pieces of the passage, around the window length
        a = rng.randrange(40)
        piece = " ".join(p[a:a + rng.randrange(9, 20)])
        docs.append((100 + i, words(i, rng.randrange(40), 50) + " " + piece.upper() + ", " + words(i + 9, rng.randrange(300), 50)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "the short,one"), (204, "x"), (205, "é à ü " * 7), (200, passage), (None, passage),
             (206, "same word " * 300), (207, passage + " " + "y" * 100_000), (208, words(6, 20_000) + passage + " z"), (206, "same word " * 300),
             (209, words(3, 12)), (210, words(2, 13)), (211, "null ID item\nhere")]
    assert found(frame(docs), frame(items, "item_id long, text string")) == plain(docs, items)


def test_empty_tables(frame):
    docs, items = [(1, "a b c")], [(1, "a b c")]
    assert found(frame([]), frame(items, "item_id long, text string")) == []
    assert found(frame(docs), frame([], "item_id long, text string")) == plain(docs, [])


def test_contaminated_rows_go(frame, words):
    passage = words(1, 30)
    rows = [(1, passage), (1, words(2, 50)), (2, words(3, 1000) + " " + passage), (None, passage), (4, None), (5, words(5, 10))]
    left = decontaminate.decontaminate(frame(rows), frame([(1, passage)], "item_id long, text string"))
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == sorted([rows[1], rows[2], rows[4], rows[5]], key=repr)
    assert left.columns == frame(rows).columns


def test_every_shared_window_keeps_a_fingerprint():
    rng = np.random.default_rng(0)
    for length in (1, 2, 5, 12, 13):
        shared = rng.integers(0, 3, length).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 3, 20), shared, rng.integers(0, 3, 20)]).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 3, 7), shared, rng.integers(0, 3, 9)]).astype(np.uint64)
        one = np.zeros(100, np.int64)
        pa, _ = decontaminate.winnow(wordhash.mix(a + np.uint64(1)), one[:len(a)], length)
        pb, _ = decontaminate.winnow(wordhash.mix(b + np.uint64(1)), one[:len(b)], length)
        assert {p - 20 for p in pa if 20 <= p < 20 + length} & {p - 7 for p in pb if 7 <= p < 7 + length}
