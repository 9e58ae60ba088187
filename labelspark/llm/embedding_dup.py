"""Near-duplicate embeddings by Euclidean p-stable hashing.

1. Equal vectors of one label collapse into a class; copies cost nothing from here on.
2. Normalised vectors are projected on random Gaussian directions, shifted and cut into cells of width ``WIDTH``.  ``k`` cells
   together (with label and number of components) are the bucket of one table; there are several tables.  For unit vectors a cosine of
   0.98 is a distance of 0.2, so the chance of sharing a cell is known: ``k`` keeps unrelated vectors apart (fewer than
   ``STRAY`` strangers a bucket), and the number of tables makes the chance of missing a pair at the threshold ``MISS``.
3. Buckets of up to ``SMALL_BUCKET`` classes are joined pair by pair.  Larger ones are compared in blocks of bounded size, each
   a task of its own, which hand on counts and a spanning forest of their links instead of pairs.
4. Every candidate is confirmed by its cosine in double precision.  A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelspark.llm.graph import components
from labelspark.llm.storage import write_table
from labelspark.llm.wordhash import mix

THRESHOLD = 0.98
WIDTH = 1.6  # of a cell, on unit vectors
MISS = 1e-6  # chance that a pair at the threshold shares no bucket
STRAY = 1 / 16  # expected orthogonal vectors of the same label in a bucket
SMALL_BUCKET = 64  # classes of a bucket that is joined pair by pair
BLOCK = 512  # classes on one side of a block
CHUNK = 1 << 16  # links handled at once
SEED = 20_011


def share(distance: float, width: float = WIDTH) -> float:
    """The probability that two points at a distance fall into one cell of a Gaussian projection."""
    ratio = width / distance
    inside = erf(ratio / sqrt(2))  # 1 - 2 * normal cdf of -ratio
    return inside - 2 / (sqrt(2 * pi) * ratio) * (1 - exp(-ratio * ratio / 2))


def table_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(cells per bucket, tables) for ``n`` vectors of one label.

    Both grow with the logarithm and a small power of n; the chance of a miss stays the same at every size.
    """
    cells = max(1, ceil(log(max(n, 2) / STRAY) / -log(share(sqrt(2)))))
    near = share(sqrt(2 - 2 * threshold)) ** cells
    return cells, ceil(log(MISS) / log(1 - near))


class Hasher:
    """Bucket keys of unit vectors; the directions depend on the seed and the number of components alone."""

    def __init__(self, cells: int, tables: int):
        self.cells, self.tables, self._drawn = cells, tables, {}

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Keys (uint64), one row per vector and one column per table."""
        dim, n = unit.shape[1], self.cells * self.tables
        if dim not in self._drawn:
            rng = np.random.default_rng([SEED, dim])
            self._drawn[dim] = rng.standard_normal((n, dim)).T, rng.random(n) * WIDTH
        directions, shifts = self._drawn[dim]
        cell = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64)
        cell = cell.reshape(len(unit), self.tables, self.cells)
        keys = np.broadcast_to(mix(np.arange(1, self.tables + 1, dtype=np.uint64)), (len(unit), self.tables)).copy()
        for i in range(self.cells):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, i])
        return mix(keys + np.uint64(dim))


def unit_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of a column of valid vectors, one group for each number of components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        rows = flat[starts[at][:, None] + np.arange(dim)]
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        yield at, rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components given and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~odd, F.lit(False))


def _bucket_rows(hasher: Hasher):
    """Arrow batches of (node, label, vector) to (bucket, place, node); the label is part of the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            labels = mix(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            for at, unit in unit_rows(batch.column(2)):
                for low in range(0, len(at), 2048):
                    some = at[low:low + 2048]
                    keys = mix(hasher(unit[low:low + 2048]) ^ labels[some][:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(hasher.tables, dtype=np.int32), len(some))),
                         pa.array(np.repeat(nodes[some], hasher.tables))], names=["bucket", "place", "node"])
    return run


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first table in which two rows of keys agree (0 where none does)."""
    return (left == right).argmax(axis=1)


def _confirm(hasher: Hasher, threshold: float):
    """Arrow batches of (a, b, place, vector_a, vector_b) to the links that meet first in that place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = {len(u[0]): (at, u) for at, u in unit_rows(batch.column(4)) if len(at)}
            for at, unit in unit_rows(batch.column(3)):
                if unit.shape[1] not in right:
                    continue
                there, others = right[unit.shape[1]]
                both, i, j = np.intersect1d(at, there, return_indices=True)  # same length on both sides
                linked = np.flatnonzero((unit[i] * others[j]).sum(axis=1) >= threshold)
                both, u, v = both[linked], unit[i[linked]], others[j[linked]]
                place = batch.column(2).to_numpy(zero_copy_only=False)[both]
                first = _first_shared(hasher(u), hasher(v)) == place if len(both) else np.zeros(0, bool)
                keep = pa.array(both[first])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in (0, 1)], names=["a", "b"])
    return run


def _forest(n: int, left: np.ndarray, right: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``to`` (a smaller row of the same tree for every row) after joining rows by links."""
    while len(left):
        a, b = to[left], to[right]
        apart = a != b
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(to, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            shorter = to[to]
            if (shorter == to).all():
                break
            to = shorter
    return to


def _block(hasher: Hasher, threshold: float):
    """One block (part i against part j of a bucket) to rows (a, b, weight).

    Rows with b null give the number of vectors linked to class a; rows with b are links that connect all that the block links.
    """
    def run(block: pa.Table) -> pa.Table:
        i, j, place = (block.column(c)[0].as_py() for c in ("i", "j", "place"))
        node, part, copies = (block.column(c).to_numpy() for c in ("node", "part", "copies"))
        (_, unit), = unit_rows(block.column("vector"))
        keys, order = hasher(unit), np.arange(len(node))
        above, beside = order[part == i], order[part == j]
        counts, to = np.zeros(len(node), np.int64), order.copy()
        step = max(1, CHUNK * 16 // max(1, len(beside)))
        for low in range(0, len(above), step):
            some = above[low:low + step]
            x, y = np.nonzero(unit[some] @ unit[beside].T >= threshold)
            x, y = some[x], beside[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), CHUNK):
                u, v = x[at:at + CHUNK], y[at:at + CHUNK]
                earlier = np.zeros(len(u), bool)  # each pair counts in the first table that it shares
                for t in range(place):
                    earlier |= keys[u, t] == keys[v, t]
                own = ~earlier
                np.add.at(counts, u[own], copies[v[own]])
                np.add.at(counts, v[own], copies[u[own]])
                to = _forest(len(node), u, v, to)
        some, tree = np.flatnonzero(counts), np.flatnonzero(to != order)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], node[tree]]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[to[tree]], pa.int64())]),
            "weight": pa.array(np.concatenate([counts[some], np.zeros(len(tree), np.int64)]), pa.int64())})
    return run


def embedding_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                         threshold: float = THRESHOLD) -> DataFrame:
    """Duplicate groups of vectors: vec_id, n_links, component_id, kept; one row per row of ``vectors``.

    Vectors are linked if their labels are equal and their cosine in double precision is at least ``threshold``.  ``n_links``: other
    rows linked directly, equal vectors among them.  ``component_id``: the smallest id reachable.  Null, empty, zero vectors, those
    with null or non-finite components and rows without label link with nothing; neither do vectors of different length.  Rows
    with a null id take part; their group's id is the smallest other one (null if there is none).  Repeated rows are copies of
    each other.  Further columns are ignored.  A pair just at the threshold is missed with probability ``MISS``, closer ones
    less often.
    """
    double = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.xxhash64(F.col(label_column).cast("string")).alias("label"),
                            F.col(label_column).isNotNull().alias("labelled"), double.alias("vector"))
    source = source.withColumn("valid", F.col("labelled") & usable("vector"))
    valid = source.where("valid")
    classes = valid.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "vector_classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    hasher = Hasher(*table_plan(largest, threshold))

    placed = classes.select("node", "label", "vector").mapInArrow(_bucket_rows(hasher), "bucket long, place int, node long")
    shared = placed.groupBy("bucket", "place").agg(F.count("*").alias("rows")).where("rows > 1")
    buckets = write_table(placed.join(shared, ["bucket", "place"]), "vector_buckets")

    small = buckets.where(F.col("rows") <= SMALL_BUCKET)
    a, b = small.alias("a"), small.alias("b")
    met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, met).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.place").alias("place"))
    pairs = pairs.groupBy("a", "b").agg(F.min("place").alias("place"))
    for key in "ab":
        side = classes.select(F.col("node").alias(key), F.col("vector").alias(f"vector_{key}"))
        pairs = pairs.join(side, key)
    links = pairs.select("a", "b", "place", "vector_a", "vector_b").mapInArrow(_confirm(hasher, threshold), "a long, b long")
    links = write_table(links, "vector_links")

    # A larger bucket is dealt into parts; every pair of parts is a block.
    large = buckets.where(F.col("rows") > SMALL_BUCKET).withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int"))
    large = large.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select("bucket", "place", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    large = large.join(classes.select("node", "copies", "vector", F.size("vector").alias("length")), "node")
    blocks = large.groupBy("bucket", "place", "length", "i", "j").applyInArrow(_block(hasher, threshold), "a long, b long, weight long")
    blocks = write_table(blocks, "vector_blocks")

    tree = links.unionByName(blocks.where("b is not null").select("a", "b"))
    groups = components(tree, "a", "b")
    copies = classes.select(F.col("node").alias("other"), "copies")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = ends.join(copies, "other").select("node", F.col("copies").alias("weight"))
    near = near.unionByName(blocks.where("b is null").select(F.col("a").alias("node"), "weight"))
    near = near.groupBy("node").agg(F.sum("weight").alias("near"))
    groups = groups.withColumnRenamed("label", "root")
    found = classes.join(near, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.join(least, "root").select(
        "label", "vector", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = valid.select("vec_id", "label", "vector").join(found, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = source.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
