import hashlib
import random
import re
from collections import Counter

import numpy as np

from labelspark.llm import secrets
from labelspark.llm.queries import QUERIES


def plain(text):
    """(start, end, kind) by the patterns of the contract."""
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def scanned(df):
    return secrets.scan(df, secrets.train(df)).collect()


def fuzz(seed, n):
    rng = random.Random(seed)
    parts = ["token", " = ", ":", '"', "'", "API_KEY", "apikey", "PassWord", "secret", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "é", "😀",
             "\n", "x.y", "=", "deadbeefdeadbeefdeadbeef", "ſecret", "toKen"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_equal_the_stated_patterns(frame):
    rows = [(i, fuzz(i, 1 + i % 40)) for i in range(500)]
    rows += [(1000, None), (1001, ""), (1002, "token=" * 20_000), (1003, "f" * 200_000), (None, "token: abcdefgh"), (3, fuzz(3, 4)), (1004, "plain words")]
    got = scanned(frame(rows))
    base = [(r.doc_id, [(s.start, s.end, s.kind) for s in r.spans if s.kind != "markov"]) for r in got]
    assert sorted(base, key=repr) == sorted([(k, plain(t)) for k, t in rows], key=repr)
    for r in got:
        for s in r.spans:
            if s.kind == "markov":
                assert all(s.end <= b.start or s.start >= b.end for b in r.spans if b.kind != "markov")


def test_models_find_random_strings_and_leave_words(frame, words):
    rng = random.Random(2)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    plainly = ["identification", "understandable_name", "internationalisation", "get_user_settings", "4785380592391139", "representation_of_things"]
    rows = [(i, f"the {rng.choice(plainly)} of {rng.choice(plainly)} " * 20 + f'api_key = "{key()}"') for i in range(200)]
    hidden = key()
    rows.append((900, f"é the understandable_name {hidden} of internationalisation"))
    got = {r.doc_id: r.spans for r in scanned(frame(rows))}
    assert [(rows[-1][1][s.start:s.end], s.kind) for s in got[900]] == [(hidden, "markov")]
    assert all([s.kind for s in got[i]] == ["assign"] for i in range(200))


def test_empty_table_and_no_samples(frame):
    assert scanned(frame([])) == []
    assert [r.spans for r in scanned(frame([(1, "only_ordinary_identifiers here"), (2, None)]))] == [[], []]


def test_counts_equal_plain_ones(frame):
    """Every distinct run once, on one side."""
    rows = [(i, fuzz(i, 1 + i % 40)) for i in range(200)] + [(300, None), (301, ""), (302, "abc abc é abc-1"), (302, "abc abc é abc-1"), (303, "f" * 100_000)]
    random_runs = {r for _, t in rows for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A)
                   if len(m[2]) >= 6 for r in re.findall(r"[A-Za-z0-9+/_=-]+", m[2])}
    for pattern, least in (("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)):
        random_runs |= {m[0] for _, t in rows for m in re.finditer(pattern, t or "") if len(m[0]) >= least}
    every = {r for _, t in rows for r in re.findall(r"[A-Za-z0-9+/_=-]+", t or "")}
    times = Counter(r for _, t in rows for r in re.findall(r"[A-Za-z0-9+/_=-]+", t or ""))
    want = np.zeros((3, secrets.SIZE, secrets.SIZE))
    for run in every | random_runs:
        codes = [secrets.SIZE - 1, *[secrets.ALPHABET.index(c) for c in run]]
        for a, b in zip(codes, codes[1:]):
            want[2 if run in random_runs else 0, a, b] += 1
            want[1, a, b] += run not in random_runs and times[run] >= secrets.OFTEN
    assert (secrets.pair_counts(frame(rows)) == want).all() and want.sum(axis=(1, 2)).all()


def test_given_table(spark):
    """Precision and recall where the truth is known: no number, card or phone of the table is a secret; planted strings are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    ratios = secrets.train(docs)
    added = [r.text[s.start:s.end] for r in secrets.scan(docs, ratios).join(docs, "doc_id").collect() for s in r.spans if s.kind == "markov"]
    assert not [a for a in added if re.fullmatch("[0-9/+=_-]+", a)] and len(added) < 10
    rng, caught = random.Random(7), {}
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for alphabet in (letters, "0123456789abcdef"):
        for length in (16, 32):
            texts = [(i, f"und the {''.join(rng.choice(alphabet) for _ in range(length))} wo.") for i in range(200)]
            caught[len(alphabet), length] = sum(len(r.spans) for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), ratios).collect()) / 200
    assert caught[16, 16] > 0.95 and caught[16, 32] > 0.95 and caught[62, 16] > 0.6 and caught[62, 32] > 0.9, caught


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_secrets"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, x in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()


def test_runs_of_any_length_are_scored(frame):
    """The ratio alone decides: 2 for each pair reach the log odds of 13.8 with seven characters."""
    rows = [(1, "é abcdef abcdefg, x"), (2, "Ab3dE6gH9"), (3, ""), (4, None), (5, "token = Ab3dE6gH9 "), (6, "abcdefg")]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.scan(frame(rows), np.full((secrets.SIZE, secrets.SIZE), 2.0)).collect()}
    assert got == {1: [(9, 16, "markov")], 2: [(0, 9, "markov")], 3: [], 4: [], 5: [(0, 17, "assign")], 6: [(0, 7, "markov")]}


def test_scores_equal_a_plain_sum(frame):
    rng = np.random.default_rng(6)
    ratios = rng.normal(1, 3, (secrets.SIZE, secrets.SIZE))
    rows = [(i, fuzz(i, 1 + i % 30)) for i in range(300)]
    got = {(r.doc_id, s.start, s.end): s.score for r in secrets.scan(frame(rows), ratios).collect() for s in r.spans if s.kind == "markov"}
    want = {}
    for i, text in rows:
        base = plain(text)
        for m in secrets.RUN.finditer(text):
            codes = [secrets.SIZE - 1, *[secrets.ALPHABET.index(c) for c in m[0]]]
            score = sum(ratios[a, b] for a, b in zip(codes, codes[1:]))
            if score > secrets.LOG_ODDS and all(m.end() <= s or m.start() >= e for s, e, _ in base):
                want[i, m.start(), m.end()] = score
    assert got.keys() == want.keys() and any(e - s < 16 for _, s, e in want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
