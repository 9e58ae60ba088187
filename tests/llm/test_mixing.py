import hashlib
import re

import pytest

from labelspark.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    """taken by position, with the targets of the sources."""
    docs = [(k, s, len(WORD.findall(t or "")), hashlib.md5(f"mix{'' if k is None else k}".encode()).hexdigest()) for k, t, s in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, open_names, target = sum(size.values()), set(names), {}
    while True:  # give every open source its share; those above their cap stop there
        left, w = total - sum(target.values()), sum(weight[s] for s in open_names)
        full = [s for s in open_names if left * weight[s] / w > 3 * size[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_names}
            break
        for s in full:
            target[s] = 3 * size[s]
            open_names.discard(s)
        if not open_names:
            break
    copies = []
    for s in names:
        reached = 0
        for d in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] or 0, d[2])):
            reached += d[2]
            copies += [((reached + e * size[s]) * 10 // weight[s], names.index(s), d) for e in range(3)]
    used, taken, ends = 0, {d: 0 for d in docs}, sorted({c[:2] for c in copies})
    for end in ends:
        here = [c for c in copies if c[:2] == end]
        if used + sum(c[2][2] for c in here) > total:
            break
        used += sum(c[2][2] for c in here)
        for c in here:
            taken[c[2]] += c[2][2]
    return sorted([(d[0], d[2], size[d[1]], round(target[d[1]], 6), taken[d]) for d in docs], key=repr), size, target


SCHEMA = "doc_id long, text string, source string"


def result(df):
    rows = mixing.fair_mix(df).collect()
    return sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows], key=repr)


@pytest.fixture
def rows(words):
    rows = [(i, words(i, 1 + i * 7 % 60), ["a", "b", "c", "ä", None][(i * i) % 5]) for i in range(200)]
    return rows + [(300, None, "a"), (301, "", "b"), (302, " \t\x0b ", "z"), (303, words(9, 20_000), "b"), (None, "some words here", "c"),
                   (304, words(1, 500), "tiny"), (305, words(2, 30), "B")]


def test_equals_the_plain_queue(frame, rows, monkeypatch):
    want, size, target = plain(rows)
    assert result(frame(rows, SCHEMA)) == want
    assert result(frame(rows, SCHEMA)) == want
    for s in size:  # a source misses its target by its longest document at most
        taken = sum(w[4] for w, r in zip(want, sorted([(k, len(WORD.findall(t or "")), x) for k, t, x in rows], key=repr)) if r[2] == s)
        longest = max(len(WORD.findall(t or "")) for _, t, x in rows if x == s)
        assert s == "b" or abs(taken - target[s]) <= longest + 20_000


def test_limits_and_reruns(frame, rows):
    first = result(frame(rows, SCHEMA))
    assert all(r[4] in (0, r[1], 2 * r[1], 3 * r[1]) for r in first)
    assert result(frame(rows[::-1], SCHEMA).repartition(7)) == first


def test_empty_and_wordless(frame):
    assert result(frame([], SCHEMA)) == []
    assert result(frame([(1, None, None), (2, "", "a")], SCHEMA)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_documents_repeat_as_often_as_taken(frame, rows):
    rows = rows + [(304, words_row, "tiny") for words_row in [rows[-2][1]]]  # a repeated row
    df = frame(rows, SCHEMA)
    mixed = mixing.mix_documents(df)
    want = {}
    for r in mixing.fair_mix(df).collect():
        if r.copies:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and mixed.columns == df.columns
