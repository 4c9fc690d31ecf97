"""New vectors as a stream: every batch is assigned to the stored heads and kept beside the index.

An id that the index holds already, or an earlier batch, is not added again;
lists are cut over old and new rows together when the index is put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.plans.index import VectorIndex


def ingest(spark: SparkSession, stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Follow ``stream`` (vec_id, embedding).  A batch is written under its own number: a batch that is run again overwrites itself."""
    index = VectorIndex.load(spark, index_path)
    if index.config.bits or index.config.delta:
        raise ValueError("ingest into an index without codes, then code it")

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.select("vec_id", "embedding").dropDuplicates(["vec_id"]).persist()
        index.assigned(rows).write.mode("overwrite").parquet(f"{index_path}/postings_new/batch={number}")
        rows.write.mode("overwrite").parquet(f"{index_path}/vectors_new/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def with_ingested(spark: SparkSession, index_path: str) -> VectorIndex:
    """The stored index and what streams have added; of rows with one id the first batch's stays."""
    index = VectorIndex.load(spark, index_path)
    vectors, postings = (spark.read.parquet(f"{index_path}/{t}_new") for t in ("vectors", "postings"))
    first = vectors.groupBy("vec_id").agg(F.min("batch").alias("batch")).join(index.vectors.select("vec_id"), "vec_id", "left_anti")
    new, assigned = (t.join(first, ["vec_id", "batch"], "left_semi").drop("batch") for t in (vectors, postings))
    return index.joined(new, assigned)
