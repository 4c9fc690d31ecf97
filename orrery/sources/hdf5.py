"""HDF5 datasets (``train``, ``test``, ``neighbors``) as tables, where the h5py package is installed.

Files lie on a file system that all nodes mount; tasks read slices of rows.
From a table, ``vecbin``, ``fvecs`` and ``ivecs`` files come by their sinks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.vecfiles import register

ROWS_A_TASK = 50_000


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the h5py package on the driver and all executors") from e
    return h5py


def read_hdf5(spark: SparkSession, path: str, key: str) -> DataFrame:
    """vec_id and ``embedding`` (or ``neighbors``, where the dataset holds whole numbers) of one dataset."""
    with _h5py().File(path, "r") as f:
        rows, whole = f[key].shape[0], f[key].dtype.kind in "iu"
    name, kind = ("neighbors", "array<int>") if whole else ("embedding", "array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as f:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    for a in range(start, min(rows, start + ROWS_A_TASK), 2000):
                        part = f[key][a : min(rows, a + 2000, start + ROWS_A_TASK)]
                        values = pa.array(list(part), pa.list_(pa.int32() if whole else pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), values], ["vec_id", name])

    starts = spark.range(0, rows, ROWS_A_TASK).repartition(max(1, -(-rows // ROWS_A_TASK)))
    return starts.mapInArrow(run, f"vec_id bigint, {name} {kind}")


def convert_hdf5(spark: SparkSession, path: str, key: str, kind: str, target: str) -> None:
    """One dataset as a file of ``kind`` (vecbin, fvecs or ivecs)."""
    rows = read_hdf5(spark, path, key)
    register(spark)
    whole = "neighbors" in rows.columns
    writer = rows.repartitionByRange("vec_id").sortWithinPartitions(F.col("vec_id")).write.format(kind).mode("append")
    (writer.option("dtype", "int32") if whole else writer).option("path", target).save()
