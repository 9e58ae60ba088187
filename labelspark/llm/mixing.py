"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through up to three times.  A document's virtual finish
time is the number of tokens of its queue up to its end, divided by the weight of the source.  All copies of all documents
are range-sorted by that time, and the mix ends where the total budget is used up.  A queue that runs dry leaves its share
to the others in proportion to their weights, so the targets need no special treatment in the sort.

Running totals within a source are prefix sums in two levels (sorted partitions of the shuffled order, then rows of one), and those
over the sorted copies likewise: no source, no id and no order is ever in one task.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window, functions as F

from labelspark.llm.order import packed, unpacked
from labelspark.llm.storage import write_table

WEIGHTS = (5, 2, 1)  # by source in code-point order, repeating
MOST_COPIES = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, weight, place (order of sources), target.

    ``sizes``: one row per source with source_size.  Targets share the total by weight, none above ``most`` times its
    source's size; with caps c and weights w the level L solves sum(min(c, w L)) = total.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(full), F.lit(0))) / F.sum("weight").over(rest)
    leveled = listed.withColumn("level", level)
    # The first source that its share does not fill up has the common level; later ones compute a lower one.
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max(fits).over(Window.partitionBy()))
    return leveled.select("source", "source_size", "weight", "place", target.alias("target"))


def _prefix(df: DataFrame, groups: list[str], order: list[str], value: str) -> DataFrame:
    """The sum of ``value`` in all earlier rows of the (small) table ``df``, by group."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("base", F.coalesce(F.sum(value).over(before), F.lit(0)))


def fair_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
             weights: tuple[int, ...] = WEIGHTS, budget: int | None = None, most: int = MOST_COPIES) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies, taken, text_key.

    Size: words between white space (null: 0).  ``budget``: words of the mix, by default all sizes together; ``target`` is
    stated for that default.  ``copies``: how often the mix holds the document (0 to ``most``); taken = size * copies.
    The mix ends with the last copy that still fits into the budget, so a source may miss its target by one document.
    The order is a hash of the id, so reruns agree.  A null source is a source of its own, after all others.  Null ids take
    part; repeated rows count each time.  Documents without words use no budget; they are in as often as the words before.
    """
    size = F.coalesce(F.regexp_count(text_column, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    # Fixed form of the shuffle key, so that plain SQL can repeat it.
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).alias("source"), size.alias("size"),
                       key.alias("key"), F.xxhash64(text_column).alias("text_key"))
    rows = write_table(rows, "mix_rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    # The shuffled order of each source, range-sorted; rows of one id or with equal texts do not gather either.
    order = ["key", "doc_id", "text_key", "size", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("source", *order)
    rows = write_table(rows.withColumn("slice", F.spark_partition_id()), "mix_slices")  # written once, so the numbers hold
    by_slice = write_table(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix_sizes")
    sources = source_targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
    sources = write_table(sources, "mix_sources")

    bases = _prefix(by_slice, ["source"], ["slice"], "slice_size").select(
        F.col("source").alias("s"), F.col("slice").alias("l"), "base")
    placed = rows.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l")))
    within = Window.partitionBy("source", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("reached", F.col("base") + F.sum("size").over(within))
    named = sources.select(F.col("source").alias("s2"), "source_size", "weight", "place", "target")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("s2")))
    unit = lcm(*weights)
    copy = lambda e: (F.col("reached") + e * F.col("source_size")) * (F.lit(unit) / F.col("weight")).cast("long")
    timed = write_table(placed.select("doc_id", "source", "size", "source_size", "target", "place", "text_key",
                                      F.array(*[copy(e) for e in range(most)]).alias("finish")), "mix_finish")

    copies = timed.where("size > 0").select(F.explode("finish").alias("finish"), "place", "size")
    ordered = copies.repartitionByRange("finish", "place").withColumn("part", F.spark_partition_id())
    ordered = write_table(ordered, "mix_order")  # written once, so the partition numbers hold
    parts = _prefix(ordered.groupBy("part").agg(F.sum("size").alias("part_size")), [], ["part"], "part_size")
    running = F.sum("size").over(Window.partitionBy("part").orderBy("finish", "place"))
    cut = ordered.join(parts, "part").withColumn("used", F.col("base") + running).where(F.col("used") <= budget)
    last = cut.agg(F.max(F.struct("finish", "place")).alias("last")).first()["last"]  # one row

    if last is None:
        held = F.lit(0).cast("long")
    else:
        in_mix = lambda f: (f < last["finish"]) | ((f == last["finish"]) & (F.col("place") <= last["place"]))
        held = F.size(F.filter("finish", in_mix)).cast("long")
    return timed.select("doc_id", "source", "size", "source_size", "target", held.alias("copies"),
                        (F.col("size") * held).alias("taken"), "text_key")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with all columns of ``docs``, whatever their names.

    Null ids, texts and sources take part; of repeated rows (one id, text and source) as many stay as the mix takes.  An empty table
    gives no rows; texts are read whole.
    """
    plan = fair_mix(docs, id_column, text_column, source_column).where("copies > 0")
    order = Window.partitionBy("doc_id", "text_key", "source").orderBy(F.desc("copies"))
    plan = plan.select("doc_id", "text_key", "source", "copies", F.row_number().over(order).alias("turn"))
    row = F.col("row")
    marked = packed(docs).select("row", row.getField(id_column).cast("long").alias("m_id"), F.xxhash64(row.getField(text_column)).alias("m_key"),
                                 row.getField(source_column).alias("m_source"))
    marked = marked.withColumn("m_turn", F.row_number().over(Window.partitionBy("m_id", "m_key", "m_source").orderBy(F.lit(1))))
    match = (F.col("m_id").eqNullSafe(F.col("doc_id")) & (F.col("m_key") == F.col("text_key"))
             & F.col("m_source").eqNullSafe(F.col("source")) & (F.col("m_turn") == F.col("turn")))
    repeated = marked.join(plan, match).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(repeated, docs.columns)
