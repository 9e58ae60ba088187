"""Secret scans with two character Markov models.

Fixed patterns find the plain cases (assignments, access keys, long hexadecimal runs).  Their values are the labelled samples
of random strings, all other runs of letters and digits those of ordinary identifiers: words, names, numbers.  Every distinct run of
the whole corpus counts once on its side, however often it occurs; otherwise the ordinary side would be prose, in which digits
are rare and every number looks random.  A run of any length is reported if its log-likelihood ratio exceeds the log odds
against a run being a secret.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelspark.llm import wordhash

LOG_ODDS = float(np.log(1e6))  # one run in a million is taken to be a secret
SMOOTH = 0.5  # added to every character count
BACK_OFF = (20, 1_000)  # pairs' worth of weight of single characters: ordinary runs, random strings (nearly without memory)
OFTEN = 8  # occurrences from which a run is evidence for itself
COUNTED_BYTES = 8 << 20  # text whose runs are reduced to distinct ones at once; a longer text is taken by itself

# The kinds, in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

SIZE = len(ALPHABET) + 1  # the last symbol stands for the start of a run


def symbols() -> np.ndarray:
    """Symbol of each byte value; -1 outside the alphabet."""
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    return table


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str) -> list[str]:
    """The labelled random strings of a text."""
    found = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= 20] + [m[0] for m in HEX.finditer(text) if len(m[0]) >= 24]


def _runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the runs of alphabet characters within single texts."""
    inside = table[data[offsets[0]:offsets[-1]]] >= 0
    edges = offsets[:-1] - offsets[0]
    edges = edges[edges < len(inside)]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[edges] = inside[edges]
    end[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    end[before] = inside[before]
    first, last = np.flatnonzero(start) + offsets[0], np.flatnonzero(end) + 1 + offsets[0]
    long = last - first >= least
    return first[long], last[long]


def _scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray,
            ratios: np.ndarray) -> np.ndarray:
    """Sums of the ratios of all character pairs of each run."""
    if not len(first):
        return np.zeros(0)
    coded = table[data[offsets[0]:offsets[-1]]]
    before = np.empty_like(coded)
    before[1:] = coded[:-1]
    before[first - offsets[0]] = SIZE - 1
    inside = coded >= 0
    starts = np.concatenate([[0], np.cumsum(last - first)[:-1]])
    return np.add.reduceat(ratios[before[inside], coded[inside]], starts)


def _suspects(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts that may hold a base span: a keyword, or a run of 20 characters."""
    raw = data[offsets[0]:offsets[-1]].tobytes().lower()
    found = np.zeros(len(offsets) - 1, bool)
    for word in KEYWORDS:
        at = raw.find(word)
        while at >= 0:  # then on to the next text
            text = int(np.searchsorted(offsets, at + offsets[0], side="right")) - 1
            found[text] = True
            at = raw.find(word, int(offsets[text + 1] - offsets[0]))
    first, _ = _runs(data, offsets, table, 20)
    found[np.searchsorted(offsets, first, side="right") - 1] = True
    return np.flatnonzero(found)


def _distinct_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, random): the runs of texts, and those of labelled random strings, each once for every slice of texts."""
    table = symbols()
    for batch in batches:
        data, offsets = wordhash.utf8(batch.column(0))
        for low, high in wordhash.slices(offsets, COUNTED_BYTES):
            own = offsets[low:high + 1]
            first, last = _runs(data, own, table, 1)
            text = data[own[0]:own[-1]]
            kept = np.ascontiguousarray(text[table[text] >= 0])  # the runs one after the other
            bounds = np.concatenate([[0], np.cumsum(last - first)])
            runs = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(kept)]).value_counts()
            random = {run for i in _suspects(data, own, table) for value in _values(data[own[i]:own[i + 1]].tobytes().decode()) for run in RUN.findall(value)}
            labelled, n = pa.array(sorted(random), pa.large_string()), len(runs)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([runs.field("values"), labelled]).cast(pa.string()), pa.array([False] * n + [True] * len(labelled)),
                pa.concat_arrays([runs.field("counts"), pa.array([0] * len(labelled), pa.int64())])], names=["run", "random", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of one task's distinct runs: ordinary ones, those of them that occur often, and random strings."""
    table = symbols()
    counts = np.zeros((3, SIZE * SIZE), np.int64)
    for batch in batches:
        data, offsets = wordhash.utf8(batch.column(0))
        random, often = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        coded = table[data[offsets[0]:offsets[-1]]]
        before = np.empty_like(coded)
        before[1:] = coded[:-1]
        before[offsets[:-1] - offsets[0]] = SIZE - 1
        pairs = before * SIZE + coded
        for side, of in enumerate((~random, ~random & (often >= OFTEN), random)):
            counts[side] += np.bincount(pairs[np.repeat(of, np.diff(offsets))], minlength=SIZE * SIZE)
    pairs = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(pairs), *[pa.array(c[pairs]) for c in counts]], names=["pair", "ordinary", "often", "random"])


def pair_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """How often each character follows another (``SIZE`` - 1: the start): in distinct ordinary runs, in those of them that occur
    ``OFTEN``, and in distinct random strings.  A run that occurs as a random string anywhere is one everywhere.
    """
    runs = docs.select(text_column).mapInArrow(_distinct_runs, "run string, random boolean, n long")
    runs = runs.groupBy("run").agg(F.max("random").alias("random"), F.sum("n").alias("n"))
    sides = ("ordinary", "often", "random")
    counts = runs.mapInArrow(_count, ", ".join(f"{c} long" for c in ("pair", *sides)))
    rows = counts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in sides]).collect()  # SIZE^2 at most
    out = np.zeros((3, SIZE * SIZE))
    for r in rows:
        out[:, r["pair"]] = [r[c] for c in sides]
    return out.reshape(3, SIZE, SIZE)


def train(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Log-likelihood ratios (random to ordinary) of all character pairs; zeros without a labelled random string.

    Every ordinary count is less by one, so that a run is no evidence for itself: a secret that nobody has labelled is one of
    the ordinary runs, and often the only one with its pairs.  Runs that occur ``OFTEN`` keep their count.
    """
    ordinary, often, random = pair_counts(docs, text_column)
    if not random.sum():
        return np.zeros((SIZE, SIZE))

    def log_rates(table: np.ndarray, back_off: int) -> np.ndarray:
        """Pair rates that fall back on single characters where a pair is rare."""
        single = (table.sum(axis=0) + SMOOTH) / (table.sum() + SMOOTH * SIZE)
        return np.log((table + back_off * single) / (table.sum(axis=1, keepdims=True) + back_off))

    return log_rates(random, BACK_OFF[1]) - log_rates(np.maximum(ordinary - 1, often), BACK_OFF[0])


def scan(docs: DataFrame, ratios: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: doc_id, spans (array of start, end, kind, score), in order.

    Positions count code points, ends are exclusive.  Kind ``markov`` marks runs found by the models alone; they never
    overlap a base span.  A null or empty text has no spans; null ids stay.  Repeated rows each get their own result, long texts
    are read whole, in one piece each; further columns are ignored, and an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbols()
        for batch in batches:
            data, offsets = wordhash.utf8(batch.column(1))
            for low, high in wordhash.slices(offsets):
                own = offsets[low:high + 1]
                found: list[list] = [[] for _ in range(high - low)]
                for i in _suspects(data, own, table):
                    found[i] = [(*s, None) for s in base_spans(data[own[i]:own[i + 1]].tobytes().decode())]
                first, last = _runs(data, own, table, 1)
                scores = _scores(data, own, table, first, last, ratios)
                high_scores = np.flatnonzero(scores > LOG_ODDS)
                for s, e, score in zip(first[high_scores].tolist(), last[high_scores].tolist(), scores[high_scores].tolist(), strict=True):
                    i = int(np.searchsorted(own, s, side="right")) - 1
                    # code points before the run: bytes that do not continue a character
                    at = int(np.count_nonzero((data[own[i]:s] & 0xC0) != 0x80))
                    span = (at, at + e - s)
                    if all(span[1] <= b[0] or span[0] >= b[1] for b in found[i]):
                        found[i].append((*span, "markov", score))
                rows = [[{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in sorted(f, key=lambda s: (s[0], KINDS.index(s[2])))]
                        for f in found]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(rows, kind)],
                                                 names=["doc_id", "spans"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>")
