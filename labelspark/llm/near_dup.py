"""MinHash near duplicates with sequential Bayesian verification.

1. Every document becomes a sketch: number of distinct five-word shingles, an order-free 128-bit key of the set, 128 MinHash
   values.  Documents with the same set collapse into one node, so exact copies cost nothing from here on.
2. Signatures are cut into 32 bands of 4.  A pair of similarity 0.75 misses all bands with probability 5e-6.
3. Set sizes and private shingles (held by no other node that shares a bucket) give an exact upper bound for a pair's
   similarity.  Nodes and pairs that cannot reach 0.75 are left out of all that follows.
4. Star rounds: within a bucket every node is paired with the bucket's hub only (the node with the smallest private share,
   so the one nearest to the common source).  Links merge components, and buckets that lie in one component are done.  A
   group of thousands of near copies thus costs a few pairs per node and band.
5. The buckets that still hold several components are compared completely, but only across components: small ones by a
   join (at most ``SMALL_BUCKET`` partners a node), large ones in blocks of bounded size, each a task of its own, which
   hand on links instead of pairs.
6. Every candidate pair is compared in batches of signature values.  It is dropped as soon as the posterior probability of
   a similarity of at least 0.75 falls below ``MISS``; survivors are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelspark.llm import wordhash
from labelspark.llm.graph import components
from labelspark.llm.order import packed, unpacked
from labelspark.llm.storage import write_table

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100  # the link threshold as a fraction
BANDS, ROWS = 32, 4
BATCH = 32  # signature values compared between two looks at the posterior
MISS = 1e-9  # accepted probability of dropping a pair at the threshold, per look
STAR_ROUNDS = 2
SMALL_BUCKET = 64  # nodes of a bucket that is joined pair by pair
BLOCK_WEIGHT = 400_000  # shingles (and 256 for each node) on one side of a block

SEPARATORS = [(0x20, 0x20), (0x09, 0x0D)]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of documents with their sorted distinct shingle hashes; an empty array where there is no word."""
    hasher = wordhash.WordHasher(wordhash.word_bytes(SEPARATORS))
    data, offsets = wordhash.utf8(column)
    for low, high in wordhash.slices(offsets):
        words, bounds, _ = hasher(data, offsets[low:high + 1])
        runs = wordhash.grams(words, SHINGLE)
        sets = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - start >= SHINGLE:
                sets.append(np.unique(runs[start:end - SHINGLE + 1]))
            elif end > start:
                sets.append(wordhash.whole(words[start:end]).reshape(1))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield low, high, sets


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32) of consecutive non-empty sets."""
    seeds = wordhash.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    out = np.empty((BANDS * ROWS, len(starts)), dtype=np.uint32)
    for i in range(BANDS * ROWS):
        hashed = values * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1]
        np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32), starts, out=out[i])
    return np.ascontiguousarray(out.T)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column(0), batch.column(2)
        for low, high, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            keys, sigs = [None] * len(sets), [None] * len(sets)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for row, k, s in zip(full, set_key(values, starts), signatures(values, starts), strict=True):
                    keys[row], sigs[row] = k.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, high - low), marks.slice(low, high - low), pa.array(sizes), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "cid", "sig"])


def set_key(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set; equal for equal sets."""
    return np.stack([np.add.reduceat(wordhash.mix(values + np.uint64(salt)), starts) for salt in (11, 97)], axis=1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets in shingle_sets(batch.column(0)):
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets)
            keys = [k.tobytes() for k in set_key(values, bounds[:-1])]
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["cid", "shingles"])


def keep_from(matches_of: int, threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> int:
    """The fewest matches among ``matches_of`` values with P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum.
    """
    n, total = matches_of + 1, 0.0
    for m in range(n):
        total += comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if total >= miss:
            return m
    return n


WIDTH = BANDS * ROWS


def likely(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the signature pairs that the sequential comparison keeps."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for seen in range(BATCH, WIDTH + 1, BATCH):
        part = slice(seen - BATCH, seen)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= keep_from(seen)]
    return alive


def _signature_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _bayes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            alive = pa.array(likely(_signature_matrix(batch.column(2)), _signature_matrix(batch.column(3))))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(alive) for c in (0, 1)], names=["a", "b"])


def _block_links(block: pa.Table) -> pa.Table:
    """The links between the two parts of a block (or within its only part), across components."""
    part, first, second = (block.column(c).to_numpy() for c in ("part", "i", "j"))
    node, label, n, common = (block.column(c).to_numpy() for c in ("node", "label", "n", "common"))
    sigs, lists = _signature_matrix(block.column("sig")), block.column("shingles").combine_chunks()
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows, others = np.flatnonzero(part == second[0]), np.flatnonzero(part == first[0])
    if not len(rows) or not len(others):  # a part that no node was dealt to
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    members = [flat[bounds[r]:bounds[r + 1]] for r in rows]
    vocabulary, places = np.unique(np.concatenate(members), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(m) for m in members])[:-1]])
    found = []
    for x in others:
        most = np.minimum(common[x], common[rows])
        open_rows = (label[rows] != label[x]) & (DENOMINATOR * most >= NUMERATOR * (n[x] + n[rows] - most))
        if first[0] == second[0]:
            open_rows &= node[rows] > node[x]
        near = np.flatnonzero(open_rows)
        near = near[likely(np.broadcast_to(sigs[x], (len(near), WIDTH)), sigs[rows[near]])]
        if len(near):
            own = flat[bounds[x]:bounds[x + 1]]
            at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            held = np.zeros(len(vocabulary), np.int64)
            held[at[vocabulary[at] == own]] = 1
            shared = np.add.reduceat(held[places], starts)[near]
            linked = rows[near[DENOMINATOR * shared >= NUMERATOR * (n[x] + n[rows[near]] - shared)]]
            found += [(min(node[x], node[y]), max(node[x], node[y])) for y in linked]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


class _Verifier:
    """Sequential comparison and exact confirmation of candidate pairs of nodes."""

    def __init__(self, classes: DataFrame, sets: DataFrame):
        self.sigs, self.sets = classes.select("node", "sig"), sets.select("node", "shingles")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        def both(df: DataFrame, side: DataFrame, column: str) -> DataFrame:
            for key in "ab":
                df = df.join(side.select(F.col("node").alias(key), F.col(column).alias(f"{column}_{key}")), key)
            return df

        staged = both(pairs, self.sigs, "sig").select("a", "b", "sig_a", "sig_b")
        survivors = write_table(staged.mapInArrow(_bayes, "a long, b long"), f"{name}_survivors")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        sizes = F.size("shingles_a") + F.size("shingles_b")
        exact = both(survivors, self.sets, "shingles").where(DENOMINATOR * shared >= NUMERATOR * (sizes - shared))
        return write_table(exact.select("a", "b"), name)


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components that the links connect."""
    if links.isEmpty():
        return labels
    ends = links
    for key in "ab":
        ends = ends.join(labels.select(F.col("node").alias(key), F.col("label").alias(f"label_{key}")), key)
    merged = components(ends, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("_to"))
    joined = labels.join(merged, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return write_table(joined, "labels")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept, group_key (one value per group of linked rows; null
    without words), text_key (xxhash64 of the text).

    A row without words (null, empty, separators only) has no shingles and stays alone.  Repeated rows are copies of each
    other.  Rows with a null id take part; their group's id is the smallest non-null one (null if there is none).
    Further columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketch = source.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _sketch, "doc_id long, text_key long, n_shingles long, cid binary, sig binary")
    sketch = write_table(sketch, "sketch")
    worded = sketch.where("n_shingles > 0")
    classes = worded.groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"),
                                        F.first("sig").alias("sig"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = classes.select("node", F.explode(band).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = write_table(bands.join(shared.select("bucket"), "bucket").select("bucket", "node"), "buckets")
    labels = write_table(buckets.select("node").distinct().withColumn("label", F.col("node")), "labels")
    sets = _open_sets(source, sketch, classes, labels)
    verifier = _Verifier(classes, sets)
    bounds = write_table(_bounds(sets), "bounds")

    tested = None
    for turn in range(STAR_ROUNDS):
        state = _open_buckets(buckets, labels, bounds)
        share = (F.col("n") - F.col("common")) / F.col("n")
        # First the very best hub, later another good one.
        order = [share, F.xxhash64("node")] if turn == 0 else [F.floor(share * 10), F.xxhash64("node", F.lit(turn))]
        rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "node", "label", "n", "common")
        hubs = state.groupBy("bucket").agg(F.min(rank).alias("h"))
        hubs = hubs.select("bucket", *[F.col(f"h.{c}").alias(f"hub_{c}") for c in ("node", "label", "n", "common")])
        stars = state.join(hubs, "bucket").where("label <> hub_label")
        stars = stars.where(_reach(F.col("n"), F.col("common"), F.col("hub_n"), F.col("hub_common")))
        pairs = stars.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = write_table(pairs, "star_pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _relabel(labels, verifier.links(pairs, "star_links"))

    rest = write_table(_open_buckets(buckets, labels, bounds), "open_buckets")
    weights = rest.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.col("n") + 256).alias("weight"))
    sized = rest.join(weights, "bucket")
    pairs = _cross_pairs(sized.where(F.col("rows") <= SMALL_BUCKET)).join(tested, ["a", "b"], "left_anti")
    links = verifier.links(write_table(pairs, "cross_pairs"), "cross_links")
    blocks = _cross_blocks(sized.where(F.col("rows") > SMALL_BUCKET), classes, sets)
    labels = _relabel(labels, links.unionByName(write_table(blocks, "block_links")))

    groups = classes.join(labels, "node", "left").select("cid", "first_id", F.coalesce("label", "node").alias("group_key"))
    least = groups.groupBy("group_key").agg(F.min("first_id").alias("component_id"))
    groups = groups.join(least, "group_key").select("cid", "group_key", "component_id")
    out = sketch.select("doc_id", "text_key", "n_shingles", "cid").join(groups, "cid", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "group_key", "text_key")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group, and every row without words.

    Of a group the row with the smallest id stays (null ids last), of repeated rows one.  Fewer rows go than stay, so the rows that
    go are anti-joined; Spark's own size check decides whether they are broadcast.  Columns of ``docs`` may have any name; an empty
    table gives no rows.
    """
    groups = write_table(near_duplicates(docs, id_column, text_column).where("n_shingles > 0"), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("best")
    first = groups.groupBy("group_key").agg(best, F.count("*").alias("rows")).where("rows > 1")
    members = groups.join(first, "group_key")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    gone = write_table(members.where(~is_best).select("doc_id", "text_key").distinct(), "gone")
    repeated = members.where(is_best).groupBy("doc_id", "text_key").count().where("count > 1")
    repeated = write_table(repeated.select("doc_id", "text_key"), "repeated")

    row = F.col("row")
    marked = packed(docs).select("row", row.getField(id_column).cast("long").alias("m_id"), F.xxhash64(row.getField(text_column)).alias("m_key"))

    def match(side: DataFrame):
        return marked["m_id"].eqNullSafe(side["doc_id"]) & (marked["m_key"] == side["text_key"])

    stay = marked.join(gone, match(gone), "left_anti")
    if not repeated.isEmpty():  # rows given several times
        once = stay.join(repeated, match(repeated), "left_semi").dropDuplicates(["m_id", "m_key"])
        stay = stay.join(repeated, match(repeated), "left_anti").unionByName(once)
    return unpacked(stay, docs.columns)


def _open_sets(source: DataFrame, sketch: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, shingles, n) of the nodes that share a bucket with another, from the text of one document each."""
    wanted = classes.join(labels, "node", "left_semi").select("cid", "node", "n", F.col("first_id").alias("doc_id"))
    # An id may be null or repeat with other texts, so the class is told by the set key, not by the id.
    texts = source.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    texts = texts.unionByName(source.where("doc_id is null").select("text"))
    found = texts.mapInArrow(_sets, "cid binary, shingles array<long>").join(wanted, "cid")
    return write_table(found.select("node", "shingles", "n").dropDuplicates(["node"]), "sets")


def _bounds(sets: DataFrame) -> DataFrame:
    """(node, n, common): set size, and shingles that some other open node holds as well; without nodes that cannot link."""
    items = sets.select("node", F.explode("shingles").alias("shingle"))
    private = items.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    private = private.groupBy("node").agg(F.count("*").alias("private"))
    bounds = sets.select("node", "n").join(private, "node", "left")
    bounds = bounds.select("node", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common"))
    return bounds.where(F.col("common") * DENOMINATOR >= F.col("n") * NUMERATOR)


def _reach(n: Column, n_common: Column, m: Column, m_common: Column) -> Column:
    """Whether sets of n and m shingles could reach the threshold.

    At most s = min(n_common, m_common) shingles are shared, so the similarity is at most s / (n + m - s).
    """
    most = F.least(n_common, m_common)
    return DENOMINATOR * most >= NUMERATOR * (n + m - most)


def _open_buckets(buckets: DataFrame, labels: DataFrame, bounds: DataFrame) -> DataFrame:
    """(bucket, node, label, n, common) of the buckets that hold several components."""
    state = buckets.join(labels.join(bounds, "node"), "node").select("bucket", "node", "label", "n", "common")
    mixed = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return state.join(mixed.select("bucket"), "bucket")


def _cross_blocks(rest: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components within large buckets, found in blocks of bounded size."""
    parts = F.ceil(F.col("weight") / BLOCK_WEIGHT).cast("int")
    dealt = rest.withColumn("parts", parts).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("bucket", "node", "label", "n", "common", "part", other.alias("other"))
    dealt = dealt.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    full = dealt.join(classes.select("node", "sig"), "node").join(sets.select("node", "shingles"), "node")
    return full.groupBy("bucket", "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def _cross_pairs(rest: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in one bucket that could reach the threshold."""
    a, b = rest.alias("a"), rest.alias("b")
    reach = _reach(F.col("a.n"), F.col("a.common"), F.col("b.n"), F.col("b.common"))
    close = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node"))
                   & (F.col("a.label") != F.col("b.label")) & reach)
    return close.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
