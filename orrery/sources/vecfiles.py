"""Vector files as Spark sources and sinks: ``vecbin``, ``fvecs`` and ``ivecs``.

All are little endian.  ``vecbin`` is a header of two u32 (rows, dim), then
rows of dim elements, f32 or, with option ``dtype=int32``, i32.  ``fvecs`` and
``ivecs`` repeat the dim as i32 before each row.  The sources and sinks open
files by path, on a file system that all nodes mount; ``read_fixed`` and
``read_variable`` take whole files (2 GB each) from any store that Spark reads.
Records of the sources have one length, and a row's id is its place in the file
(plus ``idOffset``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"vecbin": "f", "fvecs": "f", "ivecs": "i"}
ROWS_A_PART = 100_000


def _parse_header(head: bytes, kind: str, size: int) -> tuple[int, int, int, int]:
    """Rows, dim, first byte of row 0, bytes from row to row."""
    if kind == "vecbin":
        n, dim = struct.unpack("<II", head[:8])
        if 8 + 4 * n * dim > size:
            raise ValueError("the file is shorter than its header says")
        return n, dim, 8, 4 * dim
    if not size:
        return 0, 0, 4, 4
    (dim,) = struct.unpack("<i", head[:4])
    step = 4 + 4 * dim
    if dim < 0 or size % step:
        raise ValueError("the file holds no whole number of records")
    return size // step, dim, 4, step


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.type = "<i4" if kind == "ivecs" or options.get("dtype") == "int32" else "<f4"
        self.offset = int(options.get("idoffset", 0))
        self.most = int(options["maxrows"]) if "maxrows" in options else None
        self.rows_a_part = int(options.get("rowsperpartition", ROWS_A_PART))

    def _shape(self) -> tuple[int, int, int, int]:
        import os

        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            return _parse_header(f.read(8), self.kind, size)

    def partitions(self) -> list[InputPartition]:
        n = self._shape()[0]
        n = n if self.most is None else min(n, self.most)
        return [_Rows(a, min(n, a + self.rows_a_part)) for a in range(0, n, self.rows_a_part)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        _, dim, first, step = self._shape()
        whole = self.type == "<i4"
        with open(self.path, "rb") as f:
            for a in range(partition.start, partition.stop, 1000):
                n = min(partition.stop, a + 1000) - a
                f.seek(first + a * step)
                # the last row ends without the next one's dim
                data = np.frombuffer(f.read((n - 1) * step + 4 * dim) + b"\0" * (step - 4 * dim), self.type).reshape(n, step // 4)
                flat = pa.array(np.ascontiguousarray(data[:, :dim]).ravel(), pa.int32() if whole else pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), flat)
                ids = pa.array(np.arange(a, a + n) + self.offset, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, lists], ["vec_id", "neighbors" if self.kind == "ivecs" or whole else "embedding"])


class _Message(WriterCommitMessage):
    def __init__(self, part: str | None, rows: int, dim: int):
        self.part, self.rows, self.dim = part, rows, dim


class _Writer(DataSourceWriter):
    """Each task writes its rows beside the target; the commit joins them in order of partition."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.type = "<i4" if kind == "ivecs" or options.get("dtype") == "int32" else "<f4"

    def write(self, iterator: Iterator[Any]) -> _Message:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, rows, dim = f"{self.path}.part-{context.partitionId():05d}-{context.taskAttemptId()}", 0, 0
        with open(part, "wb") as f:
            for row in iterator:
                values = np.asarray(row[1], self.type)
                if rows and len(values) != dim:
                    raise ValueError("rows have different lengths")
                rows, dim = rows + 1, len(values)
                if self.kind != "vecbin":
                    f.write(struct.pack("<i", dim))
                f.write(values.tobytes())
        return _Message(part, rows, dim)

    def commit(self, messages: list[_Message | None]) -> None:
        import os
        import shutil

        parts = sorted((m for m in messages if m and m.part), key=lambda m: m.part)
        dims = {m.dim for m in parts if m.rows}
        if len(dims) > 1:
            raise ValueError("rows have different lengths")
        with open(self.path, "wb") as out:
            if self.kind == "vecbin":
                out.write(struct.pack("<II", sum(m.rows for m in parts), max(dims, default=0)))
            for m in parts:
                with open(m.part, "rb") as f:
                    shutil.copyfileobj(f, out)
                os.remove(m.part)

    def abort(self, messages: list[_Message | None]) -> None:
        import os

        for m in messages:
            if m and m.part and os.path.exists(m.part):
                os.remove(m.part)


class _VectorFiles(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        whole = self.kind == "ivecs" or self.options.get("dtype") == "int32"
        return "vec_id bigint, neighbors array<int>" if whole else "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.kind, {k.lower(): v for k, v in self.options.items()})


class VecBin(_VectorFiles):
    kind = "vecbin"


class FVecs(_VectorFiles):
    kind = "fvecs"


class IVecs(_VectorFiles):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    """Make the formats known; their files lie on a file system that all nodes mount."""
    for source in (VecBin, FVecs, IVecs):
        spark.dataSource.register(source)


def read_fixed(spark: SparkSession, path: str, kind: str, dim: int, dtype: str = "f") -> DataFrame:
    """Rows of ``fvecs``/``ivecs`` from any store that Spark reads: whole files as binary, cut in executors."""
    whole = dtype == "i"

    def cut(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = np.frombuffer(content.as_py(), "<i4" if whole else "<f4").reshape(-1, dim + 1)[:, 1:]
                values = pa.array(list(raw), pa.list_(pa.int32() if whole else pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw))), values], ["vec_id", "v"])

    if kind not in ("fvecs", "ivecs"):
        raise ValueError("kind must be fvecs or ivecs")
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(cut, f"vec_id bigint, v array<{'int' if whole else 'float'}>").select("vec_id", F.col("v").alias("embedding"))


def read_variable(spark: SparkSession, path: str) -> DataFrame:
    """query_id, neighbors of truth files whose records, of any length, are an i32 count and so many i32 ids."""

    def cut(batches):
        for batch in batches:
            for content in batch.column(0):
                raw, at, lists = np.frombuffer(content.as_py(), "<i4"), 0, []
                while at < len(raw):
                    if raw[at] < 0 or at + 1 + raw[at] > len(raw):
                        raise ValueError("the file ends within a record")
                    lists.append(raw[at + 1 : at + 1 + raw[at]])
                    at += 1 + int(raw[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lists))), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "neighbors"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(cut, "query_id bigint, neighbors array<int>")


def generated(spark: SparkSession, n: int, dim: int, kind: str = "uniform", seed: int = 42) -> DataFrame:
    """Seeded vectors: ``uniform`` in [0, 1), ``unit`` normalised, ``sin`` grid, or ``constant`` rows."""
    from orrery.functions.vectors import normalized

    i, j = F.col("id"), F.sequence(F.lit(0), F.lit(dim - 1))
    uniform = F.transform(j, lambda k: F.pmod(F.xxhash64(i, k, F.lit(seed)), F.lit(10_000)) / 10_000.0)
    values = {
        "uniform": uniform,
        "unit": normalized(F.transform(uniform, lambda x: x - 0.5)),
        "sin": F.transform(j, lambda k: F.sin((i * dim + k).cast("double"))),
        "constant": F.transform(j, lambda _: i.cast("double")),
    }[kind]
    return spark.range(n).select(i.alias("vec_id"), values.cast("array<float>").alias("embedding"))
