"""A binary column compressed with a zstd dictionary that is trained on a bounded sample of its values.

Parquet compresses pages by itself; a dictionary helps values that are stored one by one, such as single lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 10 << 20


def trained(rows: DataFrame, column: str, size: int = 64 << 10, seed: int = 42) -> bytes:
    """A dictionary of at most ``size`` bytes, from the values of the lowest hashes, at most SAMPLE_BYTES of them; empty if there are too few."""
    import zstandard

    some = rows.where(F.length(column) > 0).orderBy(F.xxhash64(column, F.lit(seed))).limit(SAMPLE_ROWS).select(F.substring(column, 1, SAMPLE_BYTES // SAMPLE_ROWS).alias("v"))
    values = [r["v"] for r in some.collect()]  # at most SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, values)) // 8)), [bytes(v) for v in values]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _mapped(rows: DataFrame, column: str, make) -> DataFrame:
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            values = pa.array([None if v.as_py() is None else change(v.as_py()) for v in batch.column(at)], pa.binary())
            yield batch.set_column(at, batch.schema.names[at], values)

    return rows.mapInArrow(run, rows.schema)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def compressed(rows: DataFrame, column: str, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    """The rows with the column's values compressed; null stays null."""

    def make():
        import zstandard

        return zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)).compress

    return _mapped(rows, column, make)


def decompressed(rows: DataFrame, column: str, dictionary: bytes = b"") -> DataFrame:
    """What ``compressed`` made, as it was."""

    def make():
        import zstandard

        return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    return _mapped(rows, column, make)
