"""Balanced k-means, tree partitions, head selection and posting lists.

Models are fitted on a bounded, seeded sample (the lowest hashes) on the
driver; every row is then assigned by the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.knn import distances, matrix, nearest_points

SAMPLE_ROWS = 100_000


def sampled(vectors: DataFrame, rows: int, seed: int = 42, id_col: str = "vec_id", vec: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``rows`` rows with the lowest seeded hash."""
    some = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(vec).alias("v"))
    got = some.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(rows).toArrow()
    return got["i"].to_numpy(), matrix(got["v"].combine_chunks()) if got.num_rows else np.empty((0, 0))


def resampled(vectors: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows drawn with replacement: each as often as a Poisson variable of its share says, by hash of its id."""
    share = rows / max(1, vectors.count())
    u = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    # the Poisson distribution's steps, until what is left is below the hash's grain
    steps, p, total, k = [], math.exp(-share), 0.0, 0
    while total < 1 - 1e-15 and k < 1000:
        total += p
        steps.append(total)
        k += 1
        p *= share / k
    times = reduce(lambda a, b: a + b, ((u >= F.lit(t)).cast("int") for t in steps))
    return vectors.withColumn("_times", times).where("_times > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def strided(vectors: DataFrame, ratio: float, id_col: str = "vec_id") -> DataFrame:
    """Every round(1 / ratio)-th row by id: no ranking of the whole table."""
    return vectors.where(F.pmod(F.col(id_col), F.lit(max(1, round(1 / ratio)))) == 0)


@dataclass
class KMeans:
    centers: np.ndarray
    objective: float
    counts: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        return distances("l2", x, self.centers).argmin(1)


def seeded_centers(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next center is drawn by its squared distance to the nearest one so far."""
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < min(k, len(x)):
        share = near / near.sum() if near.sum() > 0 else None
        centers.append(x[rng.choice(len(x), p=share)])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def balanced_kmeans(x: np.ndarray, k: int, penalty: float = 0.0, rounds: int = 20, seed: int = 42) -> KMeans:
    """Lloyd's rounds with ``penalty`` times a cluster's last count added to its distances; the last assignment has none."""
    rng = np.random.default_rng(seed)
    centers = seeded_centers(x, k, rng)
    counts = np.zeros(len(centers))
    last = None
    for _ in range(rounds):
        own = (distances("l2", x, centers) + penalty * counts).argmin(1)
        if last is not None and (own == last).all():
            break
        last, counts = own, np.bincount(own, minlength=len(centers)).astype(float)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if not full.all():
            centers[~full] = x[rng.integers(len(x), size=int((~full).sum()))]
    found = distances("l2", x, centers)
    own = found.argmin(1)
    return KMeans(centers, float(found[np.arange(len(x)), own].sum()), np.bincount(own, minlength=len(centers)))


def balance(counts: np.ndarray) -> float:
    """Standard deviation of the counts over their mean."""
    return float(counts.std() / counts.mean()) if len(counts) and counts.mean() else 0.0


def auto_balanced(x: np.ndarray, k: int, seed: int = 42) -> KMeans:
    """The most even of clusterings with penalties from 10**-3 to 10**3."""
    return min((balanced_kmeans(x, k, 10.0**e, seed=seed) for e in range(-3, 4)), key=lambda m: balance(m.counts))


# --- trees: one node table for every kind of split -------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes with a way to route a vector to a child: nearest center, or a projection against a threshold."""

    kind: str
    centers: list = field(default_factory=list)
    children: list = field(default_factory=list)
    rule: list = field(default_factory=list)
    center_ids: list = field(default_factory=list)
    sizes: list = field(default_factory=list)

    def add(self, size: int, center=None, center_id: int = -1) -> int:
        for values, v in ((self.centers, center), (self.children, []), (self.rule, None), (self.center_ids, center_id), (self.sizes, size)):
            values.append(v)
        return len(self.children) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        open_ = {0: np.arange(len(x))}
        while open_:
            node, rows = open_.popitem()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            if self.kind == "bk":
                side = distances("l2", x[rows], np.array([self.centers[c] for c in kids])).argmin(1)
            else:
                dims, weights, cut = self.rule[node]
                side = (x[rows][:, dims] @ weights > cut).astype(int)
            for s, child in enumerate(kids):
                if (side == s).any():
                    open_[child] = rows[side == s]
        return out

    def table(self) -> list[tuple[int, int, int, bool]]:
        """node_id, parent_id, center_id, is_leaf."""
        parent = {c: i for i, kids in enumerate(self.children) for c in kids}
        return [(i, parent.get(i, -1), int(self.center_ids[i]), not self.children[i]) for i in range(len(self.children))]


def lloyd(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> KMeans:
    """Plain rounds from random rows until nothing moves, or ``rounds``."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    last = None
    for _ in range(rounds):
        own = distances("l2", x, centers).argmin(1)
        if last is not None and (own == last).all():
            break
        last = own
        for c in np.unique(own):
            centers[c] = x[own == c].mean(0)
    found = distances("l2", x, centers)
    own = found.argmin(1)
    return KMeans(centers, float(found.min(1).sum()), np.bincount(own, minlength=len(centers)))


def bk_tree(ids: np.ndarray, x: np.ndarray, fan_out: int = 32, leaf: int = 8, sample: int = 1000, depth: int = 50, seed: int = 42, medoids: bool = False) -> Tree:
    """Balanced k-means splits; a child's center is its row nearest to the mean, or the row with the least sum of distances.

    Sums of squared distances to all rows are least where the distance to the mean is, so both are one row up to ties;
    ``medoids`` takes plain distances, over at most ``sample`` of the rows.
    """
    tree = Tree("bk")
    todo = [(tree.add(len(x)), np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if len(rows) <= leaf or level >= depth:
            continue
        train = x[rows[:: max(1, len(rows) // sample)][:sample]]
        model = balanced_kmeans(train, min(fan_out, len(rows)), 1 / (100 * len(train)), seed=seed + node)
        own = model.assign(x[rows])
        parts = [rows[own == c] for c in range(len(model.centers)) if (own == c).any()]
        if len(parts) < 2:
            continue
        for part in parts:
            mid = part[((x[part] - x[part].mean(0)) ** 2).sum(1).argmin()]
            if medoids:
                some = part[:: max(1, len(part) // sample)][:sample]
                mid = some[np.sqrt(distances("l2", x[some], x[some])).sum(1).argmin()]
            child = tree.add(len(part), x[mid], int(ids[mid]))
            tree.children[node].append(child)
            todo.append((child, part, level + 1))
    return tree


def split_tree(x: np.ndarray, kind: str, leaf: int, top: int = 5, tries: int = 100, sample: int = 1000, seed: int = 42) -> Tree:
    """``kd``: the median of the dimension of most variance; ``tp``: the mean of the best of random projections of ``top``."""
    rng = np.random.default_rng(seed)
    tree = Tree(kind)
    todo = [(tree.add(len(x)), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        some = x[rows[:: max(1, len(rows) // sample)][:sample]]
        dims = np.argsort(-some.var(0), kind="stable")[: 1 if kind == "kd" else top]
        if kind == "kd":
            weights = np.ones(1)
            cut = float(np.partition(some[:, dims[0]], (len(some) - 1) // 2)[(len(some) - 1) // 2])
        else:
            draws = rng.normal(size=(tries, len(dims)))
            draws /= np.sqrt((draws**2).sum(1, keepdims=True))
            weights = draws[(some[:, dims] @ draws.T).var(0).argmax()]
            cut = float((some[:, dims] @ weights).mean())
        high = x[rows][:, dims] @ weights > cut
        if high.all() or not high.any():
            continue
        tree.rule[node] = (dims, weights, cut)
        for part in (rows[~high], rows[high]):
            child = tree.add(len(part))
            tree.children[node].append(child)
            todo.append((child, part))
    return tree


def _leaves(shared, extra):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                leaf = shared.value.leaf_of(x)
                if extra is not None:
                    planes, bits = extra.value
                    signs = (x @ planes.T > 0).astype(np.int64)
                    for node in np.unique(leaf).tolist():
                        if n := bits.get(node, 0):
                            rows = leaf == node
                            leaf[rows] = node + len(shared.value.children) * (1 + signs[rows][:, :n] @ (1 << np.arange(n)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf, pa.int64())], ["vec_id", "node_id"])

    return run


def memberships(vectors: DataFrame, tree: Tree, most: int | None = None, seed: int = 42) -> DataFrame:
    """vec_id, node_id: the leaf of every row.

    A tree fitted on a sample has leaves that grow with the table: those with more than ``most`` rows are split on by the
    signs of seeded projections, as many as halve them below ``most``.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    shared = sc.broadcast(tree)
    plain = rows.mapInArrow(_leaves(shared, None), "vec_id bigint, node_id bigint")
    if most is None:
        return plain
    # a row a leaf, and the tree itself is on the driver
    large = {r["node_id"]: int(np.ceil(np.log2(r["count"] / most))) for r in plain.groupBy("node_id").count().where(F.col("count") > most).collect()}
    if not large:
        return plain
    dim = rows.select(F.size("embedding")).first()[0]
    planes = np.random.default_rng(seed).normal(size=(max(large.values()), dim))
    return rows.mapInArrow(_leaves(shared, sc.broadcast((planes, large))), "vec_id bigint, node_id bigint")


def _picked(tree: Tree, select: int, split: int) -> set[int]:
    """Center ids of subtrees that are large enough, from the leaves up; what was picked no longer counts above."""
    left = list(tree.sizes)
    picked: set[int] = set()
    for node in range(len(tree.children) - 1, -1, -1):
        kids = tree.children[node]
        if kids:
            left[node] = sum(left[c] for c in kids)
        if node and left[node] >= select:
            picked.add(tree.center_ids[node])
            if left[node] > split:
                largest = sorted(kids, key=lambda c: -left[c])[: -(-len(kids) // 5)]
                picked.update(tree.center_ids[c] for c in largest)
            left[node] = 0
    return picked - {-1}


def select_heads(vectors: DataFrame, ratio: float = 0.01, sample: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Rows that stand for the data, about ``ratio`` of them: tree centers, with thresholds tuned to the ratio.

    The tree is fitted on a sample.  Beyond its size, more heads come from strides
    over the rest, by hash of the id, so that heads stay ``ratio`` of all rows.
    """
    ids, x = sampled(vectors, sample, seed)
    if not len(ids):
        return vectors.limit(0)
    tree = bk_tree(ids, x, seed=seed)
    want = max(1, round(ratio * len(ids)))
    options = (_picked(tree, select, split) for select in range(2, 101) for split in (4, 8, 16, 32, 64, 128, 200))
    best = min(options, key=lambda got: (abs(len(got) - want), len(got)))
    heads = sorted(best) or [int(ids[0])]
    spark = vectors.sparkSession
    chosen = spark.createDataFrame([(int(i),) for i in heads], "vec_id bigint")  # at most the sample
    found = vectors.join(F.broadcast(chosen), "vec_id", "left_semi")
    if len(ids) < sample:
        return found
    fitted = spark.createDataFrame([(int(i),) for i in ids], "vec_id bigint")
    parts = 1 << 30
    stride = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(parts)) < F.lit(round(ratio * parts))
    rest = vectors.where(F.col("embedding").isNotNull() & stride).join(F.broadcast(fitted), "vec_id", "left_anti")
    return found.unionByName(rest)


def assign_postings(vectors: DataFrame, heads: DataFrame, replicas: int = 8, limit: int = 118, metric: str = "l2", spill: bool = False) -> DataFrame:
    """head_id, pos, vec_id, head_dist: each row in its nearest heads' lists, each list cut to its nearest rows.

    With ``spill`` no row leaves the list of its nearest head, however long that is.
    """
    near = nearest_points(vectors, heads, replicas, metric)
    nearest = (F.col("rank") == 1) if spill else F.lit(False)
    return prune_postings(near.select(F.col("vec_id").alias("head_id"), F.col("query_id").alias("vec_id"), F.col("distance").alias("head_dist"), nearest.alias("kept")), limit)


def prune_postings(assigned: DataFrame, limit: int) -> DataFrame:
    """``pos`` from 1 by distance to the head; a head's list ends at ``limit``, but for rows that are ``kept``."""
    order = Window.partitionBy("head_id").orderBy("head_dist", "vec_id")
    placed = assigned.withColumn("pos", F.row_number().over(order))
    return placed.where((F.col("pos") <= limit) | F.col("kept")).select("head_id", "pos", "vec_id", "head_dist")
