"""Benchmark decontamination by winnowing.

A window is a run of 13 consecutive item words (an item of fewer words is one window).  With k-grams of 7 words and the
smallest hash of every 7 consecutive k-grams kept, any 13 words that a document shares with an item keep the same k-gram on
both sides, so no occurrence is missed.  Items of fewer words get fingerprints for their own length.  Fingerprints are
joined by hash, and each hit is extended word by word to the left and right: the words decide, never the hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelspark.llm import wordhash
from labelspark.llm.order import packed, unpacked
from labelspark.llm.storage import write_table

WINDOW = 13
FILTER_BITS = 1 << 24  # of the prefilter: 2 MB, whatever the size of the benchmark

SEPARATORS = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
HIT = "struct<pos:int,length:int,hash:long,before:array<string>,after:array<string>>"


def gram_of(length: int) -> int:
    """Words of a k-gram for windows of ``length`` words."""
    return length // 2 + 1


def winnow(hashes: np.ndarray, of_text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept: of each window the smallest, the rightmost of equal ones."""
    k = gram_of(length)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = wordhash.grams(hashes, k)
    best, at = gram[:n].copy(), np.zeros(n, np.int64)
    for step in range(1, length - k + 1):
        other = gram[step:step + n]
        less = other <= best
        best[less], at[less] = other[less], step
    inside = of_text[:n] == of_text[length - 1:]
    kept = np.unique((np.arange(n) + at)[inside])
    return kept, gram[kept]


def _fingerprints(lengths: list[int], whole_only: bool, bits) -> Callable:
    """Maps (id, text, text_key) to one row per text: id, text_key, n_words, its fingerprints with the words around them.

    ``whole_only``: a text shorter than the largest length is one window of its own length (items); else every text gets
    fingerprints of every length (documents).  ``bits``: a broadcast bitmap; other hashes are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wordhash.WordHasher(wordhash.word_bytes(SEPARATORS))
        known = None if bits is None else bits.value
        for batch in batches:
            data, offsets = wordhash.utf8(batch.column(1))
            for low, high in wordhash.slices(offsets):
                words, bounds, places = hasher(data, offsets[low:high + 1])
                counts = np.diff(bounds)
                of_text = np.repeat(np.arange(high - low), counts)
                hits: list[list] = [[] for _ in range(high - low)]
                for length in lengths:
                    k = gram_of(length)
                    kept, gram = winnow(words, of_text, length)
                    if whole_only and length < WINDOW:
                        fits = counts[of_text[kept]] == length
                        kept, gram = kept[fits], gram[fits]
                    if known is not None:
                        slot = gram & np.uint64(FILTER_BITS - 1)
                        in_filter = (known[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                        kept, gram = kept[in_filter], gram[in_filter]
                    for p, h in zip(kept.tolist(), gram.view(np.int64).tolist(), strict=True):
                        text = int(of_text[p])
                        first = max(int(bounds[text]), p - (length - k))
                        last = min(int(bounds[text + 1]), p + length)
                        end = int(places[last]) if last < len(places) else int(offsets[high])
                        end = min(end, int(offsets[low + text + 1]))
                        around = WORD.findall(data[int(places[first]):end].tobytes().lower().decode())
                        hits[text].append({"pos": p - int(bounds[text]), "length": length, "hash": h,
                                           "before": around[:p - first], "after": around[p - first:]})
                kind = pa.list_(pa.struct([("pos", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()),
                                           ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low),
                     pa.array(counts.astype(np.int64)), pa.array(hits, kind)], names=["id", "text_key", "n_words", "hits"])
    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span of words around a joined k-gram that document and item share; kept if it holds a window."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            left = right = 0
            for x, y in zip(reversed(r["before"]), reversed(r["item_before"])):
                if x != y:
                    break
                left += 1
            for x, y in zip(r["after"], r["item_after"]):
                if x != y:
                    break
                right += 1
            if right >= gram_of(r["length"]) and left + right >= r["length"]:
                rows.append((r["row"], r["context"], r["pos"] - left, r["pos"] + right))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "context", "start", "end"])


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key (xxhash64 of the text).

    Contaminated: at least a twentieth of the words (and at least one) lie in occurrences of item windows.  Null or empty
    texts have no words.  Repeated rows each get their own result.  An item with a null id marks words but has no id to be
    counted or listed; equal items count once per id.  Without documents or items the counts are 0.
    """
    def of(df: DataFrame, key: str, text: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))

    spark = docs.sparkSession
    shape = f"id long, text_key long, n_words long, hits array<{HIT}>"
    run = _fingerprints(list(range(1, WINDOW + 1)), True, None)
    found = write_table(of(items, item_column, item_text).mapInArrow(run, shape), "items")
    lengths = [r[0] for r in found.select(F.least("n_words", F.lit(WINDOW))).where("n_words > 0").distinct().collect()]
    prints = found.select("id", F.explode("hits").alias("h")).select("id", "h.length", "h.hash", F.col("h.before").alias(
        "item_before"), F.col("h.after").alias("item_after"))
    contexts = prints.select("length", "hash", "item_before", "item_after").distinct()
    contexts = write_table(contexts.withColumn("context", F.monotonically_increasing_id()), "contexts")
    of_items = prints.join(contexts, ["length", "hash", "item_before", "item_after"]).select("context", "id").distinct()

    slot = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = contexts.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(hash & 63 as int)))").alias("b"))
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for w, b in words.collect():  # at most FILTER_BITS / 64 rows
        bitmap[w] = b & 0xFFFFFFFFFFFFFFFF
    bits = spark.sparkContext.broadcast(bitmap)

    run = _fingerprints(sorted(lengths), False, bits)
    texts = write_table(of(docs, id_column, text_column).mapInArrow(run, shape).withColumn(
        "row", F.monotonically_increasing_id()), "fingerprints")
    hits = texts.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    joined = hits.join(contexts, ["length", "hash"]).select(
        "row", "context", "length", "pos", "before", "after", "item_before", "item_after")
    spans = write_table(joined.mapInArrow(_extend, "row long, context long, start long, end long"), "spans")

    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cover = spans.select("row", "start", "end").distinct().withColumn("reached", F.max("end").over(order))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce("reached", "start")), F.lit(0))
    cover = cover.groupBy("row").agg(F.sum(fresh).alias("n_hit"))
    held = spans.select("row", "context").distinct().join(of_items, "context").where("id is not null")
    held = held.select("row", F.col("id").cast("string").alias("item")).distinct()
    held = held.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("list"))
    out = texts.select("row", "id", "text_key", "n_words").join(cover, "row", "left").join(held, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key")


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated.

    The contaminated ones are anti-joined by id and text; Spark's own size check decides whether they are broadcast.  Null ids and
    texts stay unless they match; repeated rows stay or go together; long texts are read whole; columns may have any name; an empty table
    gives no rows.
    """
    marks = contamination(docs, items, id_column, text_column)
    gone = write_table(marks.where("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    row = F.col("row")
    marked = packed(docs).select("row", row.getField(id_column).cast("long").alias("m_id"), F.xxhash64(row.getField(text_column)).alias("m_key"))
    match = marked["m_id"].eqNullSafe(gone["doc_id"]) & (marked["m_key"] == gone["text_key"])
    return unpacked(marked.join(gone, match, "left_anti"), docs.columns)
