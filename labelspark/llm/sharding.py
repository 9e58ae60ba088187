"""Sharding by jump consistent hashing.

A key's shard comes from a short chain of jumps of a 64-bit generator: no ring, no table, and with one more shard a key
either stays or moves into the new one.  The chain is a column expression; the generator's product modulo 2^64 is put
together from 16-bit parts, since a long product would overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelspark.llm.order import numbered, packed, unpacked

SHARDS = 24
# Fixed values of the published generator: multiplier (increment 1) and the scale of a jump.
MULTIPLIER, SCALE = 2862933555777941757, 2147483648.0
MASK = 0xFFFFFFFF


def _times(x: Column, word: int) -> tuple[Column, Column]:
    """x * word as (low 32 bits, the rest), for x and word below 2^32."""
    low, high = x * (word & 0xFFFF), x * (word >> 16)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return total.bitwiseAND(F.lit(MASK)), F.shiftright(total, 32) + F.shiftright(high, 16)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state of the generator, as two halves."""
    base, carry = _times(low, MULTIPLIER & MASK)
    cross = _times(low, MULTIPLIER >> 32)[0] + _times(high, MULTIPLIER & MASK)[0]
    plus = base + 1
    up = carry + cross + F.shiftright(plus, 32)
    return up.bitwiseAND(F.lit(MASK)), plus.bitwiseAND(F.lit(MASK))


def key_halves(key: Column) -> tuple[Column, Column]:
    """A stable 64-bit key of a value (null counts as empty text), as two halves of 32 bits."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a key."""
    high, low = key_halves(key)
    state = F.struct(high.alias("high"), low.alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def jump(s: Column, _: Column) -> Column:
        up, down = _step(s["high"], s["low"])
        ahead = F.floor((s["next"] + 1) * (F.lit(SCALE) / (F.shiftright(up, 1) + 1)))
        moved = F.struct(up.alias("high"), down.alias("low"), s["next"].alias("shard"), ahead.cast("long").alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    # Every jump goes ahead by one at least, so as many steps as shards always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump, lambda s: s["shard"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard, text_key.

    Law ``key``: the id and the number of shards decide, whatever else the table holds; null ids share one key.  ``slot``
    counts a shard's rows from 0 without gaps, in the order of ids (null first).  ``grown_shard``: the shard with one more shard.

    Slots need no task per shard (see ``order.numbered``).
    """
    text = F.col(text_column)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), size.alias("size"),
                         F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
                         F.xxhash64(text).alias("text_key"))
    placed = narrow.withColumn("shard", jump_shard(F.col("doc_id"), shards))
    placed = placed.withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    slotted = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size", "text_key"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                          "grown_shard", "text_key")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with shard and slot (in place of columns of these names), in the order of shards and slots.

    Other columns may have any name.  Null ids share a shard, null texts are empty; repeated rows take a slot each, in any order.
    An empty table gives no rows.
    """
    plan = shard_rows(docs, shards, id_column, text_column).select("doc_id", "text_key", "shard", "slot")
    plan = plan.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("slot")))
    row = F.col("row")
    marked = packed(docs).select("row", row.getField(id_column).cast("long").alias("m_id"), F.xxhash64(row.getField(text_column)).alias("m_key"))
    marked = marked.withColumn("m_turn", F.row_number().over(Window.partitionBy("m_id", "m_key").orderBy(F.lit(1))))
    match = (F.col("m_id").eqNullSafe(F.col("doc_id")) & (F.col("m_key") == F.col("text_key")) & (F.col("m_turn") == F.col("turn")))
    joined = unpacked(marked.join(plan, match), [c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    return joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
