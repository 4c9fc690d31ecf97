"""Neighbourhood graphs: exact, refined over neighbours of neighbours, pruned, and searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import l2_distance
from orrery.operators.clustering import SAMPLE_ROWS, bk_tree, memberships, sampled, split_tree
from orrery.operators.knn import distances, knn_join, matrix

#: Bytes of nodes, and of edges, that a search sends to every worker.
SENT_BYTES = 256 << 20
EDGES = "src bigint, dst bigint, dist double, rank int"


def exact_graph(vectors: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """src, dst, dist, rank: the nearest ``degree`` other rows of every row.

    All pairs are compared: the truth for samples and head sets; ``tree_seeded`` is for whole tables.
    """
    near = knn_join(vectors, vectors, degree, metric, exclude_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("distance").alias("dist"), "rank")


def with_distance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    a = vectors.select(F.col("vec_id").alias("src"), F.col("embedding").alias("_a"))
    b = vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.round(l2_distance("_a", "_b"), 9).alias("dist"))


def bounded(edges: DataFrame, degree: int) -> DataFrame:
    """The nearest ``degree`` distinct neighbours of each node."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.dropDuplicates(["src", "dst"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree)


def neighbours_of_neighbours(edges: DataFrame) -> DataFrame:
    """src, dst: nodes two steps away, without the node itself; degrees are bounded, and so are these."""
    one = edges.select("src", F.col("dst").alias("mid"))
    two = edges.select(F.col("src").alias("mid"), "dst")
    return one.join(two, "mid").where("src <> dst").select("src", "dst").distinct()


def refine(edges: DataFrame, vectors: DataFrame, degree: int) -> DataFrame:
    """One round: neighbours and their neighbours, the nearest kept."""
    wider = neighbours_of_neighbours(edges).union(edges.select("src", "dst")).distinct()
    return bounded(with_distance(wider, vectors), degree)


def leaf_graph(members: DataFrame, vectors: DataFrame, degree: int) -> DataFrame:
    """Pairs within the leaves of trees (tree_id, node_id, vec_id), the nearest kept; ``memberships`` bounds the leaves."""
    a = members.select("tree_id", "node_id", F.col("vec_id").alias("src"))
    b = members.select("tree_id", "node_id", F.col("vec_id").alias("dst"))
    pairs = a.join(b, ["tree_id", "node_id"]).where("src <> dst").select("src", "dst").distinct()
    return bounded(with_distance(pairs, vectors), degree)


def tree_seeded(vectors: DataFrame, degree: int, trees: int = 4, leaf: int = 100, seed: int = 42, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Neighbours within the leaves of projection trees, each fitted on the sample and split on where a leaf has more rows."""
    _, x = sampled(vectors, sample, seed)
    every = None
    for t in range(trees):
        members = memberships(vectors, split_tree(x, "tp", leaf, seed=seed + t), leaf).withColumn("tree_id", F.lit(t))
        every = members if every is None else every.unionByName(members)
    return leaf_graph(every, vectors, degree)


def _kept(degree: int, factor: float):
    """Rows src, dst, dist, vector come sorted by src, dist and dst."""

    def chosen(dist: np.ndarray, x: np.ndarray) -> list[int]:
        kept: list[int] = []
        for j, d in enumerate(dist):
            if len(kept) == degree:
                break
            if not kept or (factor * distances("l2", x[kept], x[j : j + 1])[:, 0] >= d).all():
                kept.append(j)
        return kept

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        src, dist, x = rows.column(0).to_numpy(), rows.column(2).to_numpy(), matrix(rows.column(3))
        cuts = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), len(src)]
        at, rank = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            kept = chosen(dist[a:b], x[a:b])
            at += [a + j for j in kept]
            rank += range(1, len(kept) + 1)
        found = rows.select(["src", "dst", "dist"]).take(pa.array(at, pa.int64()))
        return found.append_column("rank", pa.array(rank, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last node of the batches so far, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            src = batch.column(0).to_numpy()
            last = int(np.searchsorted(src, src[-1]))  # sorted
            if held and (last or held[-1].column(0)[-1].as_py() != src[0]):
                yield told(held + ([batch.slice(0, last)] if last else []))
                held = []
            elif last:
                yield told([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield told(held)

    return run


def prune_relative(edges: DataFrame, vectors: DataFrame, degree: int, factor: float = 1.0) -> DataFrame:
    """Relative-neighbourhood pruning: by distance, an edge stays unless a kept neighbour is nearer to its end.

    A node's candidates are bounded by the graph's degree; batches hold many nodes.
    """
    ends = vectors.select(F.col("vec_id").alias("dst"), "embedding")
    rows = edges.select("src", "dst", "dist").join(ends, "dst").select("src", "dst", "dist", "embedding")
    sorted_ = rows.repartition("src").sortWithinPartitions("src", "dist", "dst")
    return sorted_.mapInArrow(_kept(degree, factor), EDGES)


def refine_and_prune(edges: DataFrame, vectors: DataFrame, degree: int, wide: int, rounds: int = 2) -> DataFrame:
    """Rounds of expansion to ``wide`` candidates and relative-neighbourhood pruning, all nodes at once in each."""
    for _ in range(rounds):
        edges = prune_relative(refine(edges, vectors, wide).select("src", "dst", "dist"), vectors, degree)
    return edges


def graph_from_search(vectors: DataFrame, searcher, degree: int) -> DataFrame:
    """Edges from any ``searcher(queries, k)`` that gives query_id, vec_id, distance: a tree's, an index's."""
    near = searcher(vectors, degree + 1).where("query_id <> vec_id")
    return bounded(near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("distance").alias("dist")), degree)


def refine_by_search(edges: DataFrame, nodes: DataFrame, degree: int, wide: int, factor: float = 1.0) -> DataFrame:
    """Each node searched for in the graph itself: its candidates are what the search finds, then pruned."""
    found = graph_from_search(nodes, lambda q, k: graph_search(q, nodes, edges, k), wide)
    return prune_relative(found, nodes, degree, factor)


def head_graph(heads: DataFrame, degree: int = 16, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The heads' graph (tree-seeded, refined, searched and pruned) and the nodes of their tree.

    Heads are a stated set, whose bytes are checked.
    """
    ids, x = _stated(heads, SENT_BYTES)
    seeded = refine(tree_seeded(heads, 2 * degree, seed=seed), heads, 2 * degree)
    links = refine_by_search(seeded, heads, degree, 4 * degree)
    tree = bk_tree(ids, x, seed=seed)
    return links, heads.sparkSession.createDataFrame(tree.table(), "node_id bigint, parent_id bigint, center_id bigint, is_leaf boolean")


def _stated(nodes: DataFrame, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a set whose size is checked before it is collected."""
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > most_bytes:
        raise ValueError("the graph's nodes exceed the bound of a broadcast: use nearest_points, which goes in blocks")
    got = nodes.orderBy("vec_id").select("vec_id", "embedding").toArrow()
    return got["vec_id"].to_numpy(), matrix(got["embedding"].combine_chunks()) if got.num_rows else np.empty((0, 0))


def _descent(vec: np.ndarray, x: np.ndarray, kids: dict[int, tuple[list[int], list[int]]]) -> list[int]:
    """Places of the nearest center on each level, from the root to a leaf."""
    node, path = 0, []
    while node in kids:
        children, centers = kids[node]
        best = int(distances("l2", vec[None], x[centers])[0].argmin())
        node = children[best]
        path.append(centers[best])
    return path


def _best_first(shared, k: int, entries: int, max_checks: int | None, beam: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, first, ends, kids = shared.value
        spread = np.linspace(0, len(ids) - 1, min(entries, len(ids))).astype(int).tolist()
        width = max(k, beam or k)
        for batch in batches:
            for query, vec in zip(batch.column(0).to_pylist(), matrix(batch.column(1)) if batch.num_rows else [], strict=True):
                start = list(dict.fromkeys(_descent(vec, x, kids) + spread))
                queue = [(float(d), i) for d, i in zip(distances("l2", vec[None], x[start])[0], start, strict=True)]
                heapq.heapify(queue)
                seen, found, checks = set(start), [], 0
                while queue and (max_checks is None or checks < max_checks):
                    d, i = heapq.heappop(queue)
                    if len(found) == width and d > -found[0][0]:
                        break
                    heapq.heappush(found, (-d, -int(ids[i])))
                    if len(found) > width:
                        heapq.heappop(found)
                    new = [j for j in ends[first[i] : first[i + 1]].tolist() if j not in seen]
                    seen.update(new)
                    checks += len(new)
                    for j, dj in zip(new, distances("l2", vec[None], x[new])[0] if new else [], strict=True):
                        heapq.heappush(queue, (float(dj), j))
                best = sorted((-d, -i) for d, i in found)[:k]
                cols = [[query] * len(best), [i for _, i in best], [float(d) for d, _ in best], list(range(1, len(best) + 1))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "vec_id", "distance", "rank"])

    return run


def graph_search(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, entries: int = 50, max_checks: int | None = 4096,
    beam: int | None = None, tree: DataFrame | None = None, most_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Best-first search of the graph over ``nodes`` (heads: a stated set, whose bytes are checked before they are sent).

    It starts at ``entries`` nodes spread over the ids and, with a ``tree`` (node_id, parent_id, center_id), at the
    centers on the query's way down; it ends when the ``k`` nearest so far, or the ``beam`` nearest, are nearer than
    all that waits, or after ``max_checks`` comparisons (None: without that limit).
    """
    ids, x = _stated(nodes, most_bytes)
    if edges.count() * 16 > most_bytes:
        raise ValueError("the graph's edges exceed the bound of a broadcast")
    got = edges.select("src", "dst", "rank").toArrow()
    src, dst = (np.searchsorted(ids, got[c].to_numpy()) for c in ("src", "dst"))
    order = np.lexsort((got["rank"].to_numpy(), src))
    first = np.searchsorted(src[order], np.arange(len(ids) + 1))
    kids: dict[int, tuple[list[int], list[int]]] = {}
    for r in tree.where("center_id >= 0").orderBy("node_id").collect() if tree is not None else ():  # at most two nodes a row
        children, centers = kids.setdefault(r["parent_id"], ([], []))
        children.append(r["node_id"])
        centers.append(int(np.searchsorted(ids, r["center_id"])))
    shared = queries.sparkSession.sparkContext.broadcast((ids, x, first, dst[order], kids))
    return queries.select("vec_id", "embedding").mapInArrow(
        _best_first(shared, k, entries, max_checks, beam), "query_id bigint, vec_id bigint, distance double, rank int"
    )
