"""Nearest neighbours between tables: a stated set of points, in blocks, against all rows.

The stated set is broadcast block by block, each of at most ``BLOCK_BYTES``;
tasks multiply Arrow batches of rows with it and keep running top lists, so
only k rows per point and task (or per row) reach a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of doubles of the stated set in one broadcast.
BLOCK_BYTES = 64 << 20
#: Distances are compared to so many decimals, so that equal vectors tie whatever the order of additions.
DECIMALS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, which must have one length, as doubles."""
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist(), key=str)[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    inner = x @ y.T
    if metric == "ip":
        found = -inner
    elif metric == "cosine":
        found = 1 - inner / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1))
    else:
        found = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * inner, 0)
    return np.round(found, DECIMALS)


def first_k(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of each row, ties by id."""
    k = min(k, found.shape[1])
    if found.shape[1] > 4 * k:
        limit = np.partition(found, k - 1, axis=1)[:, k - 1]
        few = int((found <= limit[:, None]).sum(1).max())
        near = np.argpartition(found, min(few, found.shape[1]) - 1, axis=1)[:, :few]
        order = np.lexsort((ids[near], np.take_along_axis(found, near, 1)), axis=1)[:, :k]
        return np.take_along_axis(near, order, 1)
    return np.lexsort((np.broadcast_to(ids, found.shape), found), axis=1)[:, :k]


def blocks(points: DataFrame, id_col: str, vec_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a stated set, at most BLOCK_BYTES of it at a time on the driver."""
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    parts = max(1, math.ceil(size["n"] * (size["d"] or 0) * 8 / BLOCK_BYTES))
    for k in range(parts):
        some = points.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == k) if parts > 1 else points
        rows = some.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).alias("v")).toArrow()
        if rows.num_rows:
            yield rows["i"].to_numpy(), matrix(rows["v"].combine_chunks())


_PAIRS = ("query_id", "vec_id", "distance")
PAIRS = "query_id bigint, vec_id bigint, distance double"


def _pairs(query: np.ndarray, vec: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    cols = (pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(dist, pa.float64()))
    return pa.RecordBatch.from_arrays(list(cols), list(_PAIRS))


def _by_point(shared, metric: str, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point_ids, points = shared.value
        best_d = np.full((len(point_ids), 0), np.inf)
        best_i = np.empty((len(point_ids), 0), np.int64)
        step = max(1, (8 << 20) // max(1, len(point_ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                found = distances(metric, points, matrix(part.column(1)))
                if exclude_self:
                    found[point_ids[:, None] == ids] = np.inf
                near = first_k(found, ids, k)
                d = np.concatenate([best_d, np.take_along_axis(found, near, 1)], axis=1)
                i = np.concatenate([best_i, ids[near]], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        flat = np.isfinite(best_d)
        yield _pairs(np.repeat(point_ids, best_d.shape[1])[flat.ravel()], best_i[flat], best_d[flat])

    return run


def _by_row(shared, metric: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point_ids, points = shared.value
        step = max(1, (8 << 20) // max(1, len(point_ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = distances(metric, matrix(part.column(1)), points)
                near = first_k(found, point_ids, k)
                pairs = _pairs(
                    np.repeat(part.column(0).to_numpy(), near.shape[1]), point_ids[near].ravel(), np.take_along_axis(found, near, 1).ravel()
                )
                yield pairs.append_column("rank", pa.array(np.tile(np.arange(1, near.shape[1] + 1), len(near)), pa.int32()))

    return run


def ranked(pairs: DataFrame, k: int, by: str = "query_id", then: str = "vec_id") -> DataFrame:
    """The ``k`` first pairs of each ``by``, with ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy("distance", then)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False,
    query_id: str = "vec_id", query_vec: str = "embedding", vec_id: str = "vec_id", vec: str = "embedding",
) -> DataFrame:
    """query_id, vec_id, distance, rank: the nearest rows of ``vectors`` for each of the stated ``queries``."""
    sc = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("bigint"), F.col(vec))
    found = [
        rows.mapInArrow(_by_point(sc.broadcast(block), metric, k, exclude_self), PAIRS)
        for block in blocks(queries.where(F.col(query_vec).isNotNull()), query_id, query_vec)
    ]
    pairs = reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], PAIRS)
    return ranked(pairs, k)


def against(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Every row beside every row of a stated set, which is broadcast in blocks of about BLOCK_BYTES.

    The set has the columns query_id and query_vec; for estimates that are column expressions.
    """
    size = stated.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query_vec")).alias("d")).first()
    parts = max(1, math.ceil(size["n"] * (size["d"] or 0) * 8 / BLOCK_BYTES))
    some = (stated.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k) for k in range(parts))
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(block)) for block in some))


def nearest_points(
    vectors: DataFrame, points: DataFrame, k: int, metric: str = "l2",
    vec_id: str = "vec_id", vec: str = "embedding", point_id: str = "vec_id", point_vec: str = "embedding",
) -> DataFrame:
    """query_id (the row), vec_id (the point), distance, rank: the nearest of a stated set for every row.

    With one block of points the rows need no shuffle: each has its whole list at once.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("bigint"), F.col(vec))
    schema = f"{PAIRS}, rank int"
    found = [rows.mapInArrow(_by_row(sc.broadcast(b), metric, k), schema) for b in blocks(points.where(F.col(point_vec).isNotNull()), point_id, point_vec)]
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    return found[0] if len(found) == 1 else ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)
