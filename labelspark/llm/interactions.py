"""What five filters remove in each of their 120 orders.

Every document comes down to a mask of the filters that it fails, so a part is at most 32 counts.  All orders are numbered
lexicographically (their Lehmer rank), and orders that begin alike lie side by side: a mask's documents go at step s by filter f in
the orders that begin with s - 1 letters outside the mask and then f, which is one interval for each such beginning.  Counts are
added where an interval begins and taken off where it ends; a running sum over the 120 ranks then gives every order at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelspark.llm.storage import write_table

FILTERS = "ABCDE"
# Fixed values of the contract.
LEAST_WORDS = 200
DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 3
SYMBOLS = "[#$%&*|]"
SPACES = "[\\x20\\x09-\\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text (not null) fails A, B, C, D."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def lehmer_rank(beginning: tuple[int, ...], n: int) -> int:
    """The rank of the first order of n filters that begins so."""
    rank, left = 0, list(range(n))
    for step, letter in enumerate(beginning):
        rank += left.index(letter) * factorial(n - 1 - step)
        left.remove(letter)
    return rank


def intervals(n: int) -> list[tuple[int, int, int, bool, int, int]]:
    """(mask, step, letter, goes, start, end): in the orders start to end - 1 the mask's documents fail the filter at that step,
    and either go there or have gone before."""
    found = []
    for step in range(1, n + 1):
        for beginning in permutations(range(n), step):
            start = lehmer_rank(beginning, n)
            end = start + factorial(n - step)
            before = sum(1 << letter for letter in beginning[:-1])
            for mask in range(1, 1 << n):
                if mask >> beginning[-1] & 1:
                    found.append((mask, step, beginning[-1], mask & before == 0, start, end))
    return found


def merged(rows: list[tuple[int, int, int, bool, int, int]]) -> list[tuple[int, int, int, bool, int, int]]:
    """Intervals that touch become one."""
    out: list = []
    for row in sorted(rows, key=lambda r: (r[:4], r[4])):
        if out and out[-1][:4] == row[:4] and out[-1][5] == row[4]:
            out[-1] = (*out[-1][:5], row[5])
        else:
            out.append(row)
    return out


def filter_interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``masks``: part, mask (bit i: fails filter i), and the longs n, good and toxic, how many rows of the part have that mask, and how many
    of them are marked so.  A mask may come in several rows.  A part is there if it has any row; an empty table gives none.
    """
    spark, size = masks.sparkSession, len(filters)
    masks = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # A few hundred numbers that depend on the number of filters alone.
    rows = merged(intervals(size))
    table = spark.createDataFrame(rows, "mask int, step int, letter int, goes boolean, start int, end int")
    hit = masks.join(F.broadcast(table), "mask")
    gone = lambda c: F.when(F.col("goes"), F.col(c)).otherwise(0)
    hit = hit.select("part", "step", "letter", "start", "end", gone("n").alias("removed"), gone("good").alias("good_lost"),
                     gone("toxic").alias("toxic_lost"), F.when(F.col("goes"), 0).otherwise(F.col("n")).alias("redundant"))
    sums = ["removed", "redundant", "good_lost", "toxic_lost"]
    ends = [F.struct(F.col("start").alias("rank"), *[F.col(c).alias(c) for c in sums]),
            F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in sums])]
    ends = hit.select("part", "step", F.explode(F.array(*ends)).alias("e")).select("part", "step", "e.*")
    # Every rank of every step is there, with zeros.
    orders = spark.createDataFrame([(i, "".join(filters[x] for x in p)) for i, p in enumerate(permutations(range(size)))],
                                   "rank int, filter_order string")
    totals = masks.groupBy("part").agg(F.sum("n").alias("total"),
                                       *[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{i}") for i in range(size)])
    steps = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    grid = steps.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(size) - 1))))
    zeros = grid.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in sums])
    delta = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = delta.select("part", "step", "rank", *[F.sum(c).over(running).alias(c) for c in sums])
    full = full.join(F.broadcast(orders), "rank").join(totals, "part")  # ranks past the last order drop out here
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    full = full.withColumn("kept", F.col("total") - F.sum("removed").over(before))
    only = F.coalesce(*[F.when(F.col("letter") == f, F.col(f"only_{i}")) for i, f in enumerate(filters)])
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return full.select("part", "filter_order", "step", "kept", "removed", "redundant", only.alias("unique_fails"), "good_lost",
                       "toxic_lost", shapley.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  lang_column: str = "lang") -> DataFrame:
    """``filter_interactions`` of the five fixed filters over whole texts, one part per language (null: empty).

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: holds any of # $ % & * |; E: the same text has a
    smaller id anywhere in the table.  A null text is an empty one (it fails A, and E like any other text); words lie between
    ASCII white space.  Rows with a null id never fail E, and no label is theirs; repeated rows of one id do not fail E on account
    of each other, and count each time.  An id with several label rows is good (quality 1) or toxic (1) if one of them says so.
    Further columns are ignored; long texts are read whole.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("part"),
                       text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    rows = write_table(rows, "filter_masks")
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = first.where("first_id < last_id").select("text_key", "first_id")
    marks = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.expr("coalesce(quality = 1, false)").cast("int").alias("good"),
                          F.expr("coalesce(toxic = 1, false)").cast("int").alias("toxic"))
    marks = marks.where("good + toxic > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.join(first, "text_key", "left").join(marks, "doc_id", "left")
    repeated = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    masks = known.groupBy("part", (F.col("mask") + repeated).alias("mask")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return filter_interactions(write_table(masks, "mask_counts"))
