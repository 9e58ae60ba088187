"""Approximate nearest neighbours: one navigable small-world graph with layers per shard, shard results merged.

Equal vectors are one node with its smallest ids (as many as a query can ask for), so a vector that a third of the rows share
costs one node.  Nodes are dealt to shards by a hash of the vector; a shard is as large as a task's memory and patience allow, since
a search visits a share of it that falls as it grows.  A shard's graph is a row of flat arrays: for every layer the members and
a table of neighbour numbers, -1 where there are fewer.  Building and searching go through the graph for many points at once: numpy
moves a whole block of beams by one step.  Vectors of different length are in different shards and never meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelspark.llm.storage import write_table

SHARD_ROWS = 100_000  # nodes of a shard, about: some 60 MB at 64 components, three minutes of building
LINKS = 24  # of a node in upper layers; twice as many in the lowest
BUILD_BEAM, SEARCH_BEAM = 96, 160
STEPS = 4  # nodes expanded in one move
SEARCH_BLOCK = 256  # beams moved together
LINK_BLOCK = 512  # nodes whose links are chosen together
QUERY_BLOCK = 16_384  # queries of a task, which has its own copy of a shard


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and similarities of the best found, best first (-1 where fewer), ``beam`` for each query; and how many nodes it compared.

    ``links``: neighbour numbers by node.  ``entry``: start nodes by query.
    """
    ids = np.full((len(queries), beam), -1, np.int64)
    visited = np.zeros(len(queries), np.int64)
    near = np.full((len(queries), beam), -np.inf, np.float32)
    for low in range(0, len(queries), SEARCH_BLOCK):
        part = slice(low, low + SEARCH_BLOCK)
        q, start = queries[part], np.sort(entry[part], axis=1)
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1  # each start node once
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(points) + 1), bool)
        seen[:, -1] = True  # the number -1
        seen[rows, start] = True
        width = max(beam, start.shape[1])
        own = np.full((len(q), width), -1, np.int64)
        sim = np.full((len(q), width), -np.inf, np.float32)
        own[:, :start.shape[1]] = start
        sim[:, :start.shape[1]] = np.where(start >= 0, np.einsum("qkd,qd->qk", points[start], q), -np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        own, sim = own[rows, order], sim[rows, order]
        opened = own < 0
        while True:
            # the best nodes of each beam that were not expanded yet
            waiting = np.where(opened, -np.inf, sim)
            pick = np.argsort(-waiting, axis=1, kind="stable")[:, :STEPS]
            live = waiting[rows, pick] > -np.inf
            active = np.flatnonzero(live.any(axis=1))
            if not len(active):
                break
            a, at = np.arange(len(active))[:, None], active[:, None]
            pick, live = pick[active], live[active]
            opened[at, pick] = True
            reached = np.where(live[:, :, None], links[own[at, pick]], -1).reshape(len(active), -1)
            reached = np.sort(reached, axis=1)
            fresh = ~seen[at, reached]
            fresh[:, 1:] &= reached[:, 1:] != reached[:, :-1]
            seen[at, np.where(fresh, reached, -1)] = True
            close = np.where(fresh, np.einsum("qkd,qd->qk", points[reached], q[active]), -np.inf)
            all_ids = np.concatenate([own[active], np.where(fresh, reached, -1)], axis=1)
            all_sim = np.concatenate([sim[active], close], axis=1).astype(np.float32)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            own[active], sim[active], opened[active] = all_ids[a, order], all_sim[a, order], all_open[a, order]
        ids[part, :own.shape[1]], near[part, :own.shape[1]] = own, sim
        visited[part] = seen[:, :-1].sum(axis=1)
    return ids, near, visited


def diverse(points: np.ndarray, base: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (best first): those nearer to the base point than to any chosen one, then
    the nearest of the rest.  ``LINK_BLOCK`` rows at a time, since each needs all similarities between its candidates."""
    if len(candidates) > LINK_BLOCK:
        parts = [slice(low, low + LINK_BLOCK) for low in range(0, len(candidates), LINK_BLOCK)]
        return np.concatenate([diverse(points, base[p], candidates[p], near[p], most) for p in parts])
    n, width = candidates.shape
    cross = np.einsum("ncd,ned->nce", points[candidates], points[candidates])
    taken, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    valid = (candidates >= 0) & (candidates != base[:, None])
    for c in range(width):
        closest = np.where(taken, cross[:, c], -np.inf).max(axis=1)
        good = valid[:, c] & (count < most) & (near[:, c] > closest)
        taken[:, c] = good
        count += good
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * (width + 1) + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    rows = np.arange(n)[:, None]
    out = np.where(valid[rows, order], candidates[rows, order], -1)
    return out if width >= most else np.pad(out, ((0, 0), (0, most - width)), constant_values=-1)


def build_layer(points: np.ndarray, most: int) -> np.ndarray:
    """Neighbour numbers of one layer; points are added in growing blocks, each linked both ways to what is there."""
    n = len(points)
    links = np.full((n, most), -1, np.int32)
    done = min(n, max(64, 2 * most))
    first = points[:done] @ points[:done].T
    np.fill_diagonal(first, -np.inf)
    order = np.argsort(-first, axis=1, kind="stable")[:, :min(done, BUILD_BEAM)]
    near = np.take_along_axis(first, order, axis=1)
    links[:done] = diverse(points, np.arange(done), np.where(near > -np.inf, order, -1), near, most)
    while done < n:
        block = np.arange(done, min(n, done + max(64, done // 2)))
        starts = np.broadcast_to(np.linspace(0, done - 1, 8).astype(np.int64), (len(block), 8))
        ids, near, _ = beam_search(points, links, points[block], starts, BUILD_BEAM)
        links[block] = diverse(points, block, ids, near, most)
        # the way back: old neighbours and the new points that chose the node, thinned out again
        source, target = np.repeat(block, most), links[block].ravel()
        source, target = source[target >= 0], target[target >= 0]
        value = np.concatenate([np.einsum("nd,nd->n", points[source[low:low + (1 << 16)]], points[target[low:low + (1 << 16)]])
                                for low in range(0, len(source), 1 << 16)] or [np.zeros(0, np.float32)])
        order = np.lexsort((-value, target))
        source, target = source[order], target[order]
        touched, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        back = np.full((len(touched), min(int(count.max()), BUILD_BEAM)), -1, np.int64)
        fits = place < back.shape[1]
        back[np.repeat(np.arange(len(touched)), count)[fits], place[fits]] = source[fits]
        for low in range(0, len(touched), LINK_BLOCK):
            some = touched[low:low + LINK_BLOCK]
            merged = np.concatenate([links[some], back[low:low + LINK_BLOCK]], axis=1)
            near = np.where(merged >= 0, np.einsum("ncd,nd->nc", points[merged], points[some]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            rows = np.arange(len(some))[:, None]
            links[some] = diverse(points, some, merged[rows, order], near[rows, order], most)
        done = int(block[-1]) + 1
    return links


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list for each array, from its buffer."""
    bounds = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([v.ravel() for v in values])).cast(kind))


GRAPH = "width int, shard int, nodes array<long>, vectors array<float>, members array<array<int>>, links array<array<int>>"


def _build(table: pa.Table) -> pa.Table:
    """The graph of one shard as a row of flat arrays: nodes, unit vectors, and for each layer its members and neighbours."""
    width, shard = (table.column(c)[0].as_py() for c in ("width", "shard"))
    vectors, nodes = _rows(table.column("vector"), width), table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    points, nodes = unit(vectors[order]), nodes[order]
    members, links, level = [], [], np.arange(len(nodes), dtype=np.int32)
    while True:
        links.append(build_layer(points[level], 2 * LINKS if not members else LINKS))
        members.append(level)
        if len(level) <= 2 * LINKS:
            break
        level = np.sort(np.random.default_rng(len(members)).permutation(level)[:max(1, len(level) // LINKS)])
    one = lambda lists: pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)
    return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": _lists([nodes], pa.int64()),
                     "vectors": _lists([points], pa.float32()), "members": one(_lists(members, pa.int32())), "links": one(_lists(links, pa.int32()))})


def search_shard(points: np.ndarray, members: list[np.ndarray], links: list[np.ndarray], queries: np.ndarray,
                 most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and similarities of the best nodes of a shard for unit vectors ``queries``, from the top layer down; and how many
    nodes of the lowest layer each query was compared with."""
    entry = None
    for layer in reversed(range(len(members))):
        own = np.zeros((len(queries), 1), np.int64) if entry is None else np.searchsorted(members[layer], entry)
        beam = SEARCH_BEAM if layer == 0 else 8
        near_points = points[members[layer]] if layer else points
        ids, near, visited = beam_search(near_points, links[layer].reshape(len(members[layer]), -1), queries, own, max(beam, most))
        if layer:
            kept = ids[:, :4]
            entry = members[layer][np.where(kept >= 0, kept, kept[:, :1])]
    return ids[:, :most], near[:, :most], visited


def _searcher(most: int) -> Callable:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"query_id": [], "node": []}
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            members, links = ([layer.values.to_numpy() for layer in left.column(c)[0].values] for c in ("members", "links"))
            points = _rows(left.column("vectors"), width)
            ids, _, _ = search_shard(points, members, links, unit(_rows(right.column("vector"), width)), most)
            held = ids.ravel() >= 0
            nodes = left.column("nodes")[0].values.to_numpy()
            found = {"query_id": np.repeat(right.column("query_id").to_numpy(), ids.shape[1])[held], "node": nodes[ids.ravel()[held]]}
        return pa.table(found, schema=pa.schema([("query_id", pa.int64()), ("node", pa.int64())]))
    return run


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame, id_column: str, vector_column: str, name: str) -> DataFrame:
    """Distinct (id, vector) of the rows that take part."""
    kept = rows.where(usable(vector_column)).where(F.col(id_column).isNotNull())
    return kept.select(F.col(id_column).cast("long").alias(name), F.transform(vector_column, lambda x: x.cast("double") + 0.0).alias("vector")).distinct()


def index_vectors(vectors: DataFrame, id_column: str, vector_column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, graphs): nodes have node, vector, ids (the smallest ``most`` + 1); graphs a row per length of vectors and shard.

    More ids of one vector cannot appear in a result: ties go to smaller ids, and only the query's own id is left out.
    """
    by_id = Window.partitionBy("vector").orderBy("id")
    few = _vectors(vectors, id_column, vector_column, "id").withColumn("turn", F.row_number().over(by_id)).where(F.col("turn") <= most + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # an id may repeat with other vectors, so nodes are named by the vector's hash; two vectors of one hash are both scored
    nodes = write_table(nodes.withColumn("node", F.xxhash64("vector")).withColumn("width", F.size("vector")), "ann_nodes")
    shards = nodes.groupBy("width").agg(F.greatest(F.lit(1), F.round(F.count("*") / SHARD_ROWS)).cast("int").alias("shards"))
    dealt = nodes.join(write_table(shards, "ann_shards"), "width").withColumn("shard", F.expr("cast(pmod(node, shards) as int)"))
    graphs = dealt.select("width", "shard", "node", "vector").groupBy("width", "shard").applyInArrow(_build, GRAPH)
    return nodes.select("node", "vector", "ids"), write_table(graphs, "ann_graphs")


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found by cosine, in double precision, ties to smaller ids.

    ``queries``: rows of the same columns; a query's own id is no candidate.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids.  A query's candidates are the vectors of its own length.  Repeated rows
    count once; further columns are ignored; empty tables give no rows.
    """
    nodes, graphs = index_vectors(vectors, id_column, vector_column, most)
    asked = write_table(_vectors(queries, id_column, vector_column, "query_id").withColumn("width", F.size("vector")), "ann_queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = graphs.select(F.col("width").alias("of_width"), F.col("shard").alias("of_shard"))
    dealt = asked.withColumn("block", block).join(shards, F.col("width") == F.col("of_width"))
    found = spread.groupBy("width", "shard", "block").cogroup(dealt.groupBy("of_width", "of_shard", "block")).applyInArrow(
        _searcher(most + 1), "query_id long, node long")
    asked = asked.drop("width")
    pairs = found.join(asked, "query_id").join(nodes.select("node", "ids", F.col("vector").alias("other")), "node")
    dot = F.aggregate(F.zip_with("vector", "other", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), (dot / (norm("vector") * norm("other"))).alias("score"))
    scored = scored.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
