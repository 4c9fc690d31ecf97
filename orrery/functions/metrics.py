"""Recall, correlation, latency and size figures as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of the first ``k`` true neighbours among the first ``k`` results."""
    got = results.where(F.col("rank") <= k).select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    true = truth.where(F.col("rank") <= k).select("query_id", "vec_id").distinct()
    joined = true.join(got, ["query_id", "vec_id"], "left")
    return joined.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def mean_recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    each = recall_at_k(results, truth, k)
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"))


def recall_by_distance(results: DataFrame, truth: DataFrame, k: int, slack: float = 1e-9) -> DataFrame:
    """query_id, recall: the share of k results that are no farther than the k-th true neighbour, so that ties count."""
    limit = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.max("distance").alias("limit"))
    near = results.where(F.col("rank") <= k).join(limit, "query_id", "right")
    hit = F.count_if(F.col("distance") <= F.col("limit") + slack)
    return near.groupBy("query_id").agg((hit / F.lit(float(k))).alias("recall"))


def truth_rows(truth: DataFrame) -> DataFrame:
    """Rows query_id, neighbors array<int> as query_id, vec_id, rank."""
    return truth.select("query_id", F.posexplode("neighbors")).select(
        "query_id", F.col("col").cast("bigint").alias("vec_id"), (F.col("pos") + 1).alias("rank")
    )


def correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.agg(F.corr(x, y).alias("correlation"))


def percentiles(values: DataFrame, column: str, by: list[str], points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact discrete percentiles, least, most and mean of each group."""
    named = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in points]
    return values.groupBy(*by).agg(
        F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), *named
    )


def throughput(values: DataFrame, seconds: str) -> DataFrame:
    """Queries a second over the sum of their times."""
    return values.agg((F.count(seconds) / F.sum(seconds)).alias("qps"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics as CSV with a header, for reports."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
