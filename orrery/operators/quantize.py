"""Residual quantizers with an unbiased distance estimator: 1 bit in columns, 2 and 4 bits in Arrow batches.

For v with centroid c: r = v - c and a code vector x.  With n = |r|^2 the inner
product <r, q - c> is estimated as n / <r, x> * <q - c, x>; distances follow
from |v - q|^2 = n + |q - c|^2 - 2 <r, q - c> and <v, q> = <c, q> + <r, q>.
The query's own part |q - c|^2 is kept, as codes of different centroids must
compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, doubles, minus, signs, total
from orrery.operators.knn import DECIMALS, blocks, distances, first_k, matrix, ranked

#: Constant of the error bound of the 1-bit estimate.
ERROR_SCALE = 1.9


def one_bit(vectors: DataFrame, centroid: str = "centroid", vec: str = "embedding") -> DataFrame:
    """Adds code (0/1), f_add, f_rescale (squared L2) and f_error, against the row's centroid."""
    r = vectors.withColumn("_r", minus(vec, centroid)).withColumn("code", signs(F.col("_r")))
    x = F.transform("code", lambda b: b - F.lit(0.5))
    r = r.withColumn("_n", dot("_r", "_r")).withColumn("_p", dot("_r", x)).withColumn("_m", dot(centroid, x))
    dim = F.size("code")
    # a zero residual needs no code: its factors are zero
    scale = F.when(F.col("_p") != 0, F.col("_n") / F.col("_p")).otherwise(F.lit(0.0))
    spread = F.when(
        (F.col("_p") != 0) & (dim > 1), (F.col("_n") * dim * 0.25 / (F.col("_p") * F.col("_p")) - 1) / (dim - 1)
    ).otherwise(F.lit(0.0))
    return (
        r.withColumn("f_add", F.col("_n") + 2 * F.col("_m") * scale)
        .withColumn("f_rescale", -2 * scale)
        .withColumn("f_error", 2 * ERROR_SCALE * F.sqrt("_n") * F.sqrt(F.greatest(spread, F.lit(0.0))))
        .drop("_r", "_n", "_p", "_m")
    )


def one_bit_l2(query: str = "query_vec", centroid: str = "centroid") -> Column:
    """Estimated squared distance of a query to a coded row."""
    x = F.transform("code", lambda b: b - F.lit(0.5))
    away = minus(query, centroid)
    return F.col("f_add") + dot(away, away) + F.col("f_rescale") * dot(query, x)


def one_bit_ip(query: str = "query_vec", centroid: str = "centroid") -> Column:
    """Estimated negated inner product: <v, q> = <c, q> + <r, q>, and <r, q> is about n / <r, x> * <q, x>."""
    x = F.transform("code", lambda b: b - F.lit(0.5))
    return -dot(centroid, query) + F.col("f_rescale") / 2 * dot(query, x)


def _estimated(shared, k: int):
    """Rows vec_id, embedding, code, f_add, f_rescale, centroid: the ``k`` nearest of each query by estimate, with exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = [np.full((len(ids), 0), np.inf), np.full((len(ids), 0), np.inf), np.empty((len(ids), 0), np.int64)]
        step = max(1, (4 << 20) // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vec = part.column(0).to_numpy()
                x = matrix(part.column(2)) - 0.5
                f_add, f_rescale = (part.column(i).to_numpy() for i in (3, 4))
                estimate = np.round(f_add + distances("l2", q, matrix(part.column(5))) + f_rescale * (q @ x.T), DECIMALS)
                near = first_k(estimate, vec, k)
                exact = distances("l2", q, matrix(part.column(1)))
                new = (np.take_along_axis(estimate, near, 1), np.take_along_axis(exact, near, 1), vec[near])
                best = [np.concatenate([a, b], axis=1) for a, b in zip(best, new, strict=True)]
                order = np.lexsort((best[2], best[0]), axis=1)[:, :k]
                best = [np.take_along_axis(b, order, 1) for b in best]
        cols = (np.repeat(ids, best[0].shape[1]), best[2].ravel(), best[0].ravel(), best[1].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "estimate", "distance"])

    return run


def one_bit_search(coded: DataFrame, queries: DataFrame, k: int, rerank: int = 5) -> DataFrame:
    """query_id, vec_id, distance, rank: of the ``k * rerank`` nearest by the 1-bit estimate, the ``k`` nearest.

    Queries are a stated set, broadcast in blocks; a task tells ``k * rerank`` rows a query, never pairs.
    """
    sc, found = coded.sparkSession.sparkContext, []
    rows = coded.select("vec_id", "embedding", "code", "f_add", "f_rescale", "centroid")
    schema = "query_id bigint, vec_id bigint, estimate double, distance double"
    for block in blocks(queries, "vec_id", "embedding"):
        found.append(rows.mapInArrow(_estimated(sc.broadcast(block), k * rerank), schema))
    pairs = reduce(DataFrame.unionByName, found) if found else coded.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("estimate", "vec_id")
    near = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k * rerank)
    return ranked(near.select("query_id", "vec_id", "distance"), k)


def levels(bits: int) -> int:
    return 1 << (bits - 1)


def best_codes(r: np.ndarray, bits: int) -> np.ndarray:
    """Magnitude codes floor(t * a), t chosen for each row to maximise <code + 1/2, a> / |code + 1/2|.

    The quotient changes only where t * a crosses an integer: all crossings are
    sorted, and sums of what each adds give the quotient after every one.
    """
    top = levels(bits) - 1
    if not top:
        return np.zeros(r.shape, np.int64)
    norms = np.sqrt((r * r).sum(1, keepdims=True))
    a = np.abs(r) / np.where(norms > 1e-12, norms, 1)
    steps = np.arange(1, top + 1)
    with np.errstate(divide="ignore"):
        crossing = (steps[None, None, :] / a[:, :, None]).reshape(len(a), -1)
    order = np.argsort(crossing, axis=1, kind="stable")
    gain = np.repeat(a, top, axis=1)
    # code j-1+1/2 becomes j+1/2: the square of the norm grows by 2j
    growth = np.tile(2.0 * steps, (a.shape[0], a.shape[1]))
    valid = np.isfinite(np.take_along_axis(crossing, order, 1))
    ip = 0.5 * a.sum(1, keepdims=True) + np.cumsum(np.take_along_axis(gain, order, 1), axis=1)
    square = 0.25 * a.shape[1] + np.cumsum(np.take_along_axis(growth, order, 1), axis=1)
    quotient = np.where(valid, ip / np.sqrt(square), -np.inf)
    best = quotient.argmax(axis=1)
    t = np.take_along_axis(np.take_along_axis(crossing, order, 1), best[:, None], 1)
    start = 0.5 * a.sum(1) / np.sqrt(0.25 * a.shape[1])
    t = np.where(np.take_along_axis(quotient, best[:, None], 1)[:, 0] >= start, t[:, 0], 0.0)
    t = np.where(np.isfinite(t), t, 0.0)
    return np.minimum(np.floor(t[:, None] * a + 1e-9), top).astype(np.int64)


def encode(vectors: np.ndarray, centroids: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Total codes 0 .. 2**bits - 1 and factors; the vector is about c + scale * x, x = code - (2**bits - 1) / 2."""
    r = vectors - centroids
    magnitude = best_codes(r, bits)
    half = levels(bits)
    codes = np.where(r >= 0, half + magnitude, half - 1 - magnitude)
    x = codes - (2 * half - 1) / 2
    n, p, xx = (r * r).sum(1), (r * x).sum(1), (x * x).sum(1)
    ratio = np.where(np.abs(p) > 1e-12, n / np.where(np.abs(p) > 1e-12, p, 1), 0.0)
    return {
        "code": codes,
        "f_add": n + 2 * ratio * (centroids * x).sum(1),
        "f_rescale": -2 * ratio,
        "r_square": n,
        "r_dot_c": (r * centroids).sum(1),
        "scale": np.where(xx > 0, p / np.where(xx > 0, xx, 1), 0.0),
    }


#: Factors are floats; a code of dim * bits bits lies in 64-bit words, lowest first.
FACTORS = ("f_add", "f_rescale", "r_square", "r_dot_c", "scale")
CODES = "head_id bigint, vec_id bigint, code array<bigint>, " + ", ".join(f"{f} float" for f in FACTORS)


def packed_words(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as rows of 64-bit words; the last word is padded with zeros."""
    each = 64 // bits
    n, dim = codes.shape
    whole = np.zeros((n, -(-dim // each) * each), np.uint64)
    whole[:, :dim] = codes
    shifts = np.arange(each, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(whole.reshape(n, -1, each) << shifts, axis=2).view(np.int64)


def code_values(bits: int, dim: Column, code: str = "code") -> Column:
    """The codes 0 .. 2**bits - 1 that ``packed_words`` laid down."""
    each, mask = 64 // bits, (1 << bits) - 1

    def value(i: Column) -> Column:
        word, place = F.floor(i / each).cast("int"), (i % each) * bits
        return F.call_function("shiftrightunsigned", F.get(F.col(code), word), place).bitwiseAND(F.lit(mask).cast("bigint"))

    return F.transform(F.sequence(F.lit(0), dim - 1), value)


def _encoded(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = encode(matrix(part.column(2)), matrix(part.column(3)), bits)
                codes = pa.array(list(packed_words(made.pop("code"), bits)), pa.list_(pa.int64()))
                cols = [part.column(0), part.column(1), codes, *(pa.array(v.astype(np.float32)) for v in made.values())]
                yield pa.RecordBatch.from_arrays(cols, ["head_id", "vec_id", "code", *made])

    return run


def multi_bit(rows: DataFrame, bits: int) -> DataFrame:
    """Codes and factors of rows head_id, vec_id, embedding, centroid."""
    if bits not in (1, 2, 4):
        raise ValueError("bits must be 1, 2 or 4")
    ids = (F.col(c).cast("bigint").alias(c) for c in ("head_id", "vec_id"))
    return rows.select(*ids, "embedding", "centroid").mapInArrow(_encoded(bits), CODES)


def multi_bit_distance(bits: int, metric: str = "l2", query: str = "query_vec", centroid: str = "centroid") -> Column:
    """Estimated distance of a query to a coded row; for ``cosine`` of unit vectors, 1 - the estimated inner product."""
    middle = (2 * levels(bits) - 1) / 2
    x = F.transform(code_values(bits, F.size(centroid)), lambda k: k.cast("double") - F.lit(middle))
    away = minus(query, centroid)
    if metric == "l2":
        return F.col("f_add").cast("double") + dot(away, away) + F.col("f_rescale").cast("double") * dot(query, x)
    # <v, q> = <c, q> + <r, c> + <r, q - c>
    inner = dot(centroid, query) + F.col("r_dot_c").cast("double") - F.col("f_rescale").cast("double") / 2 * dot(away, x)
    return 1 - inner if metric == "cosine" else -inner


def reconstructed(bits: int, centroid: str = "centroid") -> Column:
    """c + scale * x, the least-squares inverse."""
    middle = (2 * levels(bits) - 1) / 2
    codes = code_values(bits, F.size(centroid))
    return F.zip_with(doubles(centroid), codes, lambda c, k: c + F.col("scale").cast("double") * (k.cast("double") - F.lit(middle)))


def query_code(query: str = "query_vec", centroid: str = "centroid") -> Column:
    """Signs of a query's residual; the estimators keep the query whole and do not use them."""
    return signs(minus(query, centroid))


def code_bytes(rows: DataFrame) -> DataFrame:
    """Rows, bytes of vectors at four an element, and bytes of the codes and factors as they are held."""
    held = F.size("code") * 8 + 4 * len(FACTORS)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("embedding").cast("bigint") * 4).alias("raw_bytes"), F.sum(held.cast("bigint")).alias("code_bytes")
    )


def code_sum(query: Column | str) -> Column:
    """Sum of the query's elements, the constant part of inner products with unsigned codes."""
    return total(doubles(query))
