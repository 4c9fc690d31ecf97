"""The two-level index: heads, posting lists, optional codes; built, stored and searched as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import distance, dot, doubles, minus, normalized, plus
from orrery.operators.clustering import assign_postings, prune_postings, select_heads, strided
from orrery.operators.graph import graph_search, head_graph
from orrery.operators.knn import PAIRS, blocks, distances, first_k, matrix, nearest_points, ranked
from orrery.operators.quantize import multi_bit, multi_bit_distance


#: Heads that a scan of the postings is told by name, so that it skips row groups without them.
HEADS_NAMED = 2000


@dataclass(frozen=True)
class IndexConfig:
    """What a build and a search need; all of it is stored with the index."""

    metric: str = "l2"
    bits: int = 0  # 0: no codes; else 1, 2 or 4
    ratio: float = 0.01
    replicas: int = 8
    posting_limit: int = 118
    probes: int = 64
    max_check: int = 4096
    rerank: int = 3
    head_sample: int = 100_000
    heads: str = "tree"  # or "strided"
    inline: bool = False  # store vectors beside the postings, so that a search reads the probed lists alone
    delta: bool = False  # store vectors beside the postings, as differences to the head
    seed: int = 42
    square_bound: float = 0.0  # for ip: no stored vector's square is larger
    head_search: str = "exact"  # or "graph": best first over the heads' graph, from the leaves of their tree
    head_degree: int = 16
    head_checks: int = 2048


@dataclass
class VectorIndex:
    """Tables: vectors (vec_id, embedding), heads (vec_id, embedding), postings (head_id, pos, vec_id, head_dist ...)."""

    config: IndexConfig
    vectors: DataFrame
    heads: DataFrame
    postings: DataFrame
    links: DataFrame | None = None  # edges between heads: src, dst, dist, rank
    nodes: DataFrame | None = None  # the heads' tree: node_id, parent_id, center_id, is_leaf
    directory: DataFrame | None = None  # head_id, n_rows of each list: what a search must know before it reads lists

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig | None = None) -> VectorIndex:
        config = config or IndexConfig()
        rows = vectors.select("vec_id", "embedding")
        if config.metric == "ip":
            most = rows.agg(F.max(dot("embedding", "embedding")).alias("n")).first()["n"]
            config = replace(config, square_bound=float(most or 0.0))
        placed = placed_by(rows, config)
        if config.heads == "strided":
            heads = strided(rows, config.ratio)
        else:
            heads = select_heads(placed, config.ratio, config.head_sample, config.seed)
            heads = rows.join(heads.select("vec_id"), "vec_id", "left_semi") if config.metric != "l2" else heads
        # a list may hold what its share of all replicas is, if that is more than the limit
        limit = max(config.posting_limit, round(config.replicas / config.ratio))
        postings = assign_postings(placed, placed_by(heads, config), config.replicas, limit, "l2", spill=True)
        if config.bits or config.delta:
            centers = heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
            gathered = postings.join(rows, "vec_id").join(F.broadcast(centers) if _small(heads) else centers, "head_id")
            if config.bits:
                coded = multi_bit(gathered, config.bits)
                postings = postings.join(coded, ["head_id", "vec_id"])
            else:
                postings = gathered.withColumn("delta", minus("embedding", "centroid")).drop("embedding", "centroid")
        elif config.inline:
            postings = postings.join(rows, "vec_id")
        index = cls(config, rows, heads, postings)
        if config.head_search == "graph":
            index.links, index.nodes = head_graph(placed_by(heads, config), config.head_degree, config.seed)
        return index

    def probed(self, queries: DataFrame) -> DataFrame:
        """query_id, head_id, head_rank of the nearest heads."""
        asked = placed_by(queries.select("vec_id", "embedding"), self.config, query=True)
        heads = placed_by(self.heads, self.config)
        if self.config.head_search == "graph":
            near = graph_search(asked, heads, self.links, self.config.probes, max_checks=self.config.head_checks, tree=self.nodes)
        else:
            near = nearest_points(asked, heads, self.config.probes, "l2")
        return near.select("query_id", F.col("vec_id").alias("head_id"), F.col("rank").alias("head_rank"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Distinct candidates of each query, the first max_check in order of head and place, with the query's vector.

        Rows are shuffled once, by query, without vectors.
        """
        found = self.probed(queries).join(self.postings.drop("delta", "embedding"), "head_id").repartition("query_id")
        once = Window.partitionBy("query_id", "vec_id").orderBy("head_rank", "pos")
        found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
        order = Window.partitionBy("query_id").orderBy("head_rank", "pos")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= self.config.max_check).drop("_n")
        return found.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, vec_id, distance, rank.  Coded indexes rank k * rerank by codes, then exactly.

        Where vectors stand beside the postings and max_check cuts no query's lists short, lists are read in place.
        """
        if self.config.inline and not self.config.bits and not self.config.delta:
            return self.search_lists(queries, k)
        return self._search(queries, k)

    def sizes(self) -> DataFrame:
        """head_id, n_rows: the stored directory, or a count."""
        return self.directory or self.postings.groupBy("head_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def search_lists(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries go to the lists, block by block: no candidate is shuffled, each task tells its best of each query.

        A block's queries are broadcast (BLOCK_BYTES at most, as in knn) with the heads they probe; beyond ``HEADS_NAMED``
        heads the scan is not told which, and skips the others row by row.  Queries whose lists hold more than max_check
        rows, where the order of heads decides, take the other way.
        """
        sc, found = self.vectors.sparkSession.sparkContext, []
        near = self.probed(queries).join(self.sizes(), "head_id")
        near = near.withColumn("total", F.sum("n_rows").over(Window.partitionBy("query_id"))).persist()
        few = near.where(F.col("total") <= self.config.max_check)
        cut = near.where(F.col("total") > self.config.max_check).select(F.col("query_id").alias("vec_id")).distinct()
        asked = queries.select("vec_id", "embedding").where(F.col("embedding").isNotNull())
        rows = self.postings.select("head_id", "vec_id", "embedding")
        whole = asked.join(few.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
        for ids, x in blocks(whole, "vec_id", "embedding"):
            by_id = np.argsort(ids)
            block = self.vectors.sparkSession.createDataFrame(pa.table({"query_id": ids[by_id]}))
            mine = few.join(F.broadcast(block), "query_id").select("query_id", "head_id").toArrow()  # ``probes`` a query
            heads, query = mine["head_id"].to_numpy(), np.searchsorted(ids[by_id], mine["query_id"].to_numpy())
            order = np.argsort(heads, kind="stable")
            shared = sc.broadcast((ids[by_id], x[by_id], heads[order], query[order]))
            named = np.unique(heads)
            read = rows.where(F.col("head_id").isin(named.tolist())) if len(named) <= HEADS_NAMED else rows
            found.append(read.mapInArrow(_in_lists(shared, self.config.metric, k, self.config.replicas), PAIRS))
        other = self._search(queries.join(cut, "vec_id", "left_semi"), k)
        if not found:
            return other
        best = reduce(DataFrame.unionByName, found).dropDuplicates(["query_id", "vec_id"])
        best = ranked(best, k).select("query_id", "vec_id", "distance", "rank")
        return best if cut.isEmpty() else best.unionByName(other)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        found = self.candidates(queries)
        if self.config.bits:
            centers = self.heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
            found = found.join(centers, "head_id")
            found = found.withColumn("distance", multi_bit_distance(self.config.bits, self.config.metric))
            found = _top(found, k * self.config.rerank)
        if self.config.delta and not self.config.bits:
            centers = self.heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
            found = found.join(self.postings.select("head_id", "vec_id", "delta"), ["head_id", "vec_id"])
            found = found.join(centers, "head_id").withColumn("embedding", plus("delta", "centroid"))
        else:
            found = found.join(self.vectors, "vec_id")
        found = found.withColumn("distance", F.round(distance(self.config.metric, "query_vec", "embedding"), 9))
        return _top(found, k).select("query_id", "vec_id", "distance", "rank")

    def search_coded(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The estimate's own ranking, without a second look at the vectors."""
        centers = self.heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
        found = self.candidates(queries).join(centers, "head_id")
        found = found.withColumn("distance", multi_bit_distance(self.config.bits, self.config.metric))
        return _top(found, k).select("query_id", "vec_id", "distance", "rank")

    def search_stats(self, queries: DataFrame) -> DataFrame:
        """query_id, posting lists read, rows and bytes in them, and candidates checked."""
        dims = queries.select(F.col("vec_id").alias("query_id"), (F.lit(4) * F.size("embedding") + 8).alias("width"))
        read = self.probed(queries).join(self.postings.select("head_id", "vec_id"), "head_id").join(dims, "query_id")
        return read.groupBy("query_id").agg(
            F.countDistinct("head_id").alias("n_postings"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("width").alias("n_bytes"),
            F.least(F.countDistinct("vec_id"), F.lit(self.config.max_check).cast("bigint")).alias("n_checked"),
        )

    def posting_stats(self) -> DataFrame:
        """Lists, their rows, least, most and mean size, and lists a vector."""
        sizes = self.postings.groupBy("head_id").count()
        held = self.postings.agg(F.countDistinct("vec_id").alias("n_vectors"))  # one row
        stats = sizes.agg(
            F.count(F.lit(1)).alias("n_postings"), F.sum("count").alias("n_rows"), F.min("count").alias("least"),
            F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"),
        )
        return stats.crossJoin(F.broadcast(held)).withColumn("replicas", F.round(F.col("n_rows") / F.col("n_vectors"), 6))

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """head_id, vec_id, head_dist: the nearest heads of rows that the index may not hold yet."""
        near = nearest_points(placed_by(vectors, self.config), placed_by(self.heads, self.config), self.config.replicas, "l2")
        return near.select(F.col("vec_id").alias("head_id"), F.col("query_id").alias("vec_id"), F.col("distance").alias("head_dist"))

    def joined(self, new: DataFrame, assigned: DataFrame) -> VectorIndex:
        """The index with new rows and their heads: a row's nearest head keeps it, the other lists keep their nearest rows, old and new."""
        if self.config.bits or self.config.delta:
            raise ValueError("append to an index without codes, then code it")
        limit = max(self.config.posting_limit, round(self.config.replicas / self.config.ratio))
        first = Window.partitionBy("vec_id").orderBy("head_dist", "head_id")
        every = self.postings.select("head_id", "vec_id", "head_dist").unionByName(assigned).withColumn("kept", F.row_number().over(first) == 1)
        postings, vectors = prune_postings(every, limit), self.vectors.unionByName(new)
        postings = postings.join(vectors, "vec_id") if self.config.inline else postings
        return replace(self, vectors=vectors, postings=postings, directory=None)

    def appended(self, vectors: DataFrame) -> VectorIndex:
        """The index with those rows that it does not hold yet, by id; its heads stay."""
        rows = vectors.select("vec_id", "embedding").dropDuplicates(["vec_id"])
        new = rows.join(self.vectors.select("vec_id"), "vec_id", "left_anti")
        return self.joined(new, self.assigned(new))

    def save(self, path: str) -> None:
        """One Parquet table each; postings in files by range of head, so that a probe reads few row groups."""
        self.vectors.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
        self.heads.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/heads")
        by_head = self.postings.repartitionByRange("head_id").sortWithinPartitions("head_id", "pos")
        by_head.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        self.sizes().coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/directory")
        for name, part in (("links", self.links), ("nodes", self.nodes)):
            if part is not None:
                part.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        meta = self.vectors.sparkSession.createDataFrame([(json.dumps(asdict(self.config)),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cache: bool = False) -> VectorIndex:
        """Lazy tables, or cached heads and postings."""
        config = IndexConfig(**json.loads(spark.read.text(f"{path}/meta").first()["value"]))
        tables = [spark.read.parquet(f"{path}/{t}") for t in ("vectors", "heads", "postings")]
        if cache:
            tables[1:] = [t.cache() for t in tables[1:]]
        links, nodes = (spark.read.parquet(f"{path}/{t}") if config.head_search == "graph" else None for t in ("links", "nodes"))
        return cls(config, *tables, links, nodes, spark.read.parquet(f"{path}/directory"))


def _in_lists(shared, metric: str, k: int, replicas: int):
    """Rows head_id, vec_id, vector: the best of each query that probes the head.  A vector stands in ``replicas`` lists at most."""
    most = k * replicas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, heads, query = shared.value
        best_d = np.full((len(ids), most), np.inf)
        best_i = np.full((len(ids), most), -1, np.int64)
        for batch in batches:
            head, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(head)) + 1).tolist(), len(head)]
            rows = None
            for a, b in zip(cuts, cuts[1:], strict=False):
                asks = query[np.searchsorted(heads, head[a]) : np.searchsorted(heads, head[a], side="right")] if b > a else ()
                if not len(asks):
                    continue
                rows = matrix(batch.column(2)) if rows is None else rows
                d = distances(metric, x[asks], rows[a:b])
                near = first_k(d, vec[a:b], most)
                d = np.concatenate([best_d[asks], np.take_along_axis(d, near, 1)], axis=1)
                i = np.concatenate([best_i[asks], vec[a:b][near]], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :most]
                best_d[asks], best_i[asks] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        full = np.isfinite(best_d)
        cols = (np.repeat(ids, most)[full.ravel()], best_i[full], best_d[full])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "distance"])

    return run


def placed_by(rows: DataFrame, config: IndexConfig, query: bool = False) -> DataFrame:
    """vec_id, and as ``embedding`` the vector whose squared L2 distances order as the metric does.

    ``cosine`` compares unit vectors.  ``ip`` gives every stored vector one more element, that makes all squares
    ``square_bound``, and a query a zero there.
    """
    vec = F.col("embedding")
    if config.metric == "cosine":
        vec = normalized("embedding")
    elif config.metric == "ip":
        rest = F.lit(0.0) if query else F.sqrt(F.greatest(F.lit(config.square_bound) - dot("embedding", "embedding"), F.lit(0.0)))
        vec = F.concat(doubles("embedding"), F.array(rest))
    return rows.select("vec_id", vec.alias("embedding"))


def _small(heads: DataFrame, most: int = 64 << 20) -> bool:
    """Whether the heads' vectors stay under a broadcast's bound."""
    size = heads.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    return size * 4 <= most


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
