"""Runs of the index over a matrix of settings, with times, as CSV and Markdown.

    spark-submit orrery/plans/experiments.py VECTORS QUERIES REPORT

VECTORS and QUERIES are Parquet tables vec_id, embedding; REPORT is a folder.
"""

from __future__ import annotations

import itertools
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.metrics import mean_recall, percentiles, write_report
from orrery.operators.knn import knn_join
from orrery.plans.index import IndexConfig, VectorIndex

PROBES, CHECKS, BITS = (32, 64), (1024, 2048, 4096), (0, 4)


def latencies(index: VectorIndex, queries: DataFrame, k: int = 10, most: int = 20) -> DataFrame:
    """query_id and seconds of up to ``most`` queries, each searched by itself: a Spark job's fixed cost is in each."""
    ids = [r["vec_id"] for r in queries.select("vec_id").orderBy("vec_id").limit(most).collect()]
    times = []
    for i in ids:
        began = time.perf_counter()
        index.search(queries.where(F.col("vec_id") == i), k).collect()
        times.append((i, time.perf_counter() - began))
    return queries.sparkSession.createDataFrame(times, "query_id bigint, seconds double")


def run_matrix(vectors: DataFrame, queries: DataFrame, k: int = 10, probes=PROBES, checks=CHECKS, bits=BITS, most: int = 5, **more) -> DataFrame:
    """A row a setting: recall, queries a second of the whole batch, percentiles of single queries, lists and rows read."""
    truth = knn_join(queries, vectors, k).cache()
    found = None
    for b in bits:
        base = VectorIndex.build(vectors, IndexConfig(bits=b, **more))
        base.postings = base.postings.cache()
        for p, c in itertools.product(probes, checks):
            index = VectorIndex(IndexConfig(**{**vars(base.config), "probes": p, "max_check": c}), base.vectors, base.heads, base.postings)
            began = time.perf_counter()
            result = index.search(queries, k).cache()
            n = queries.count()
            result.count()
            batch = time.perf_counter() - began
            single = percentiles(latencies(index, queries, k, most).withColumn("all", F.lit(1)), "seconds", ["all"]).select("p50", "p95", "p99")
            read = index.search_stats(queries).agg(F.avg("n_postings").alias("lists"), F.avg("n_rows").alias("rows_read"), F.avg("n_checked").alias("checked"))
            row = mean_recall(result, truth, k).crossJoin(single).crossJoin(read)  # one row each
            row = row.select(F.lit(b).alias("bits"), F.lit(p).alias("probes"), F.lit(c).alias("max_check"), F.lit(round(n / batch, 2)).alias("qps"), *row.columns)
            found = row if found is None else found.unionByName(row)
            result.unpersist()
    return found


def markdown(metrics: DataFrame) -> str:
    """The rows of a report as a table."""
    rows = [metrics.columns, ["-"] * len(metrics.columns), *(["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in metrics.collect())]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows)


def main(vectors: str, queries: str, report: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    metrics = run_matrix(spark.read.parquet(vectors), spark.read.parquet(queries)).cache()
    write_report(metrics, f"{report}/csv")
    spark.createDataFrame([(markdown(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(f"{report}/markdown")


if __name__ == "__main__":
    main(*sys.argv[1:4])
