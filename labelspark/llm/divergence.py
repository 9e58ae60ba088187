"""How far the word use of sources differs, per language: an audit by Arrow compute kernels.

1. One pass over the texts: each Arrow batch is lower-cased, split, dictionary-encoded and counted by hash aggregation, so
   only counts per (language, source, term) leave it.  Spark adds them up before and after the shuffle.
2. Terms of too few documents go; totals per source and language are a second, small aggregation.
3. Distances of every pair of sources are sums over all kept terms.  Terms are dealt into shards by hash; a shard holds its counts as
   columns and adds up, for two blocks of sources, what its terms change against two sources that hold none of them.  What two
   such sources differ by is the same for every term, so it is added once, times the number of terms.

All arithmetic is on 64-bit integers.  Shares are long divisions in two steps, exact up to 9e13 occurrences a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelspark.llm.storage import write_table
from labelspark.llm.wordhash import slices

SCALE = 1_000_000_000  # shares are counted in billionths
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
COUNTED_BYTES = 16 << 20  # text counted at once
SHARD_ROWS = 200_000  # counts of a shard, about
SOURCE_BLOCK = 128  # sources on one side of a shard's matrix
CELLS = 1 << 19  # cells of a matrix of terms and sources
# Fixed value of the contract: what separates terms.
SEPARATORS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some documents, and one row with a null term for each group."""
    first: dict[tuple, int] = {}  # a group is numbered by its first row
    number = pa.array([first.setdefault(g, i) for i, g in enumerate(zip(lang.to_pylist(), source.to_pylist(), strict=True))], pa.int64())
    parts = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    row, terms = pc.list_parent_indices(parts), pc.list_flatten(parts)
    held = pc.not_equal(terms, "")  # before the first and after the last separator
    row, terms = row.filter(held), terms.filter(held).dictionary_encode()
    found = pa.table({"row": row, "term": terms.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    found = found.append_column("group", number.take(found.column("row")))
    found = found.group_by(["group", "term"]).aggregate([("count_all", "sum"), ([], "count_all")])
    at = found.column("group")
    counted = pa.table({"lang": lang.take(at), "source": source.take(at), "term": terms.dictionary.take(found.column("term")),
                        "n": found.column("count_all_sum"), "docs": found.column("count_all")})
    rows, zeros = pa.array(first.values(), pa.int64()), pa.array(np.zeros(len(first), np.int64))
    empty = pa.table({"lang": lang.take(rows), "source": source.take(rows), "term": pa.nulls(len(rows), terms.dictionary.type),
                      "n": zeros, "docs": zeros})
    return pa.concat_tables([counted.cast(empty.schema), empty])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).cast(pa.large_string()) for c in range(3)]
        offsets = np.frombuffer(columns[2].buffers()[1], np.int64)[columns[2].offset:columns[2].offset + len(batch) + 1]
        for low, high in slices(offsets, COUNTED_BYTES):  # a longer text by itself
            counts = count_terms(*[c.slice(low, high - low) for c in columns])
            for name in ("lang", "source", "term"):
                at = counts.column_names.index(name)
                counts = counts.set_column(at, name, counts.column(name).cast(pa.string()))
            yield from counts.to_batches(max_chunksize=1 << 16)


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total) for n + 1 <= total, exactly."""
    whole, rest = np.divmod(n + 1, total)
    high, rest = np.divmod(rest * 100_000, total)
    return 1 + whole * SCALE + high * 10_000 + rest * 10_000 // total


def _share(n: Column, total: Column) -> Column:
    """``share`` of columns of longs."""
    def div(x: Column) -> Column:
        return F.call_function("div", x, total)

    rest = F.pmod(n + 1, total) * 100_000
    return 1 + div(n + 1) * SCALE + div(rest) * 10_000 + div(F.pmod(rest, total) * 10_000)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _changes(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, change): what a shard's terms add to the distance of a in block i from b in block j, beyond two empty sources."""
    i, j = key[2].as_py(), key[3].as_py()
    place, total = groups.column("spot").to_numpy(), groups.column("total").to_numpy()
    order = np.argsort(place)
    place, total = place[order], np.maximum(total[order], 1)  # 0 only where there is no term either
    rows, others = np.flatnonzero(place // SOURCE_BLOCK == i), np.flatnonzero(place // SOURCE_BLOCK == j)
    terms = counts.column("term").combine_chunks().dictionary_encode()
    term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    column, n = np.searchsorted(place, counts.column("place").to_numpy()), counts.column("n").to_numpy()
    by_term = np.argsort(term, kind="stable")
    term, column, n = term[by_term], column[by_term], n[by_term]
    none = share(np.zeros(len(place), np.int64), total)
    flat = (none[rows][:, None] - none[others][None, :]) ** 2 // none[others][None, :]
    change, width = np.zeros((len(rows), len(others)), np.int64), max(1, CELLS // max(1, len(place)))
    for low in range(0, int(term[-1]) + 1 if len(term) else 0, width):
        some = slice(np.searchsorted(term, low), np.searchsorted(term, low + width))
        deep = min(width, int(term[-1]) + 1 - low)
        held = np.zeros((deep, len(place)), np.int64)
        held[term[some] - low, column[some]] = n[some]
        p = share(held, total[None, :])
        q = p[:, others]
        for at, row in enumerate(rows):
            gap = p[:, row][:, None] - q
            change[at] += (gap * gap // q).sum(axis=0) - deep * flat[at]
    a, b = np.repeat(place[rows], len(others)), np.tile(place[others], len(rows))
    keep = a != b
    return pa.table({"lang": pa.array([key[0].as_py()] * int(keep.sum()), pa.string()), "a": pa.array(a[keep], pa.int64()),
                     "b": pa.array(b[keep], pa.int64()), "change": pa.array(change.ravel()[keep], pa.int64())})


def source_divergence(docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
                      least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance of a source from every other source of its language, sum of (p - q)^2 / q (floored) over all kept
    terms.  Part ``term``: the ``top`` kept terms that the source uses more than its language, with their share of that distance.
    Shares are in billionths, with one occurrence added to each count.  Ranks go by value, descending, then item by bytes.

    Null texts, languages and sources count as empty ones.  A term is a run of letters or other non-ASCII signs; only A-Z are lowered.
    Terms in fewer than ``least`` rows of a language are left out; repeated rows count each time.  A source without terms
    still has its pairs (0 where the language keeps no term).  Long texts are read whole, each in one piece; an empty table gives no
    rows; further columns are ignored.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
            for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))]
    partial = docs.select(*text).mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    counts = write_table(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")

    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"))
    kept = write_table(kept.where(F.col("in_docs") >= least).select("lang", "term", "lang_n"), "kept_terms")
    used = write_table(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used_terms")

    # Small tables: one row per group and per language.
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("rows"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_size"), F.count("*").alias("terms"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("terms", F.lit(0)).alias("terms"),
                           (F.coalesce("size", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"),
                           (F.coalesce("lang_size", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("lang_total"))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = write_table(groups, "source_groups")

    # Terms that a source uses more than its language.
    known = used.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    own = known.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"),
                       _share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    own = own.where("p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: shards of terms, blocks of sources.
    per_lang = groups.groupBy("lang").agg((1 + F.floor(F.sum("rows") / SHARD_ROWS)).cast("int").alias("shards"),
                                          F.floor((F.max("place")) / SOURCE_BLOCK).cast("int").alias("last"))
    per_lang = write_table(per_lang, "lang_shards")
    placed = used.join(groups.select("lang", "source", "place"), ["lang", "source"]).join(per_lang, "lang")
    placed = placed.select("lang", "term", "n", "place", "last", F.expr("cast(pmod(xxhash64(term), shards) as int)").alias("shard"),
                           F.floor(F.col("place") / SOURCE_BLOCK).cast("int").alias("block"))
    every = F.sequence(F.lit(0), F.col("last"))
    blocks = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(F.col("block").alias("i"), x.alias("j"))),
                                       F.transform(every, lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))))
    placed = placed.withColumn("at", F.explode(blocks)).select("lang", "shard", "at.i", "at.j", "term", "n", "place")
    sides = groups.join(per_lang, "lang").select("lang", F.floor(F.col("place") / SOURCE_BLOCK).cast("int").alias("block"), "place",
                                                 "total", "last", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    sides = sides.withColumn("at", F.explode(blocks)).select(
        "lang", "shard", "at.i", "at.j", F.col("place").alias("spot"), "total")
    by = ["lang", "shard", "i", "j"]
    changes = placed.groupBy(*by).cogroup(sides.groupBy(*by)).applyInArrow(_changes, "lang string, a long, b long, change long")
    changes = write_table(changes.groupBy("lang", "a", "b").agg(F.sum("change").alias("change")), "pair_changes")

    name = lambda key: groups.select("lang", F.col("place").cast("long").alias(key), F.col("source").alias(f"source_{key}"),
                                     F.col("terms").alias(f"terms_{key}"), F.col("total").alias(f"total_{key}"))
    zero = F.lit(0).cast("long")
    empty = F.col("terms_a") * _distance(*[_share(zero, F.greatest(F.col(f"total_{key}"), F.lit(1))) for key in "ab"])
    pairs = changes.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"]).select(
        "lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), (F.col("change") + empty).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(own.withColumn("part", F.lit("term")).select(*columns))
