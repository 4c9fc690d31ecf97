"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: \x20 and \x09-\x0D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; an own one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark not in _own_folders:
        _own_folders[spark] = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    return _own_folders[spark]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it.

    Unlike ``DataFrame.checkpoint``, the new plan knows the true size; what
    loops of joins expect of checkpoints grows with the product of all sizes.
    ``release`` deletes a table; all that are left go when the session ends.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"orrery-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    read = spark.read.schema(df.schema).parquet(path.toString())
    _paths[read] = path.toString()
    return read


def lean_batches(docs: DataFrame, rows: int = 1000) -> None:
    """Send texts to Python in batches of at most ``rows`` rows, unless the session has fewer: a batch is held several times over."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > rows or int(conf.get(name)) <= 0:
        conf.set(name, str(rows))


def tidy(run):
    """The same function over Arrow batches; when it ends, its worker gives freed memory back, as it may wait long for more work."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they like
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def release(*tables: DataFrame) -> None:
    """Delete written tables that no plan needs any more."""
    for df in tables:
        if name := _paths.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_own_folders: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lit_long(n: int) -> Column:
    return F.lit(n).cast("long")


def prefix_sums(lengths: Column, count: Column) -> Column:
    """Exclusive prefix sums of an array<bigint> of ``count`` > 0 elements.

    Built-in functions have no scan, and growing an array in ``aggregate`` is
    quadratic.  Two levels of about sqrt(n) sums keep it at n**1.5 additions.
    """
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, lit_long(0), add)

    def by_block(width: Column) -> Column:
        starts = F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / width).cast("int")),
            lambda b: total(F.slice(lengths, F.lit(1), b * width)),
        )

        def place(heads: Column) -> Column:
            def at(i: Column) -> Column:
                b = F.floor(i / width).cast("int")
                return F.get(heads, b) + total(F.slice(lengths, b * width + 1, i - b * width))

            return F.transform(F.sequence(F.lit(0), count - 1), at)

        return let(starts, place)

    return let(F.ceil(F.sqrt(count)).cast("int"), by_block)


def match_spans(text: Column, pattern: str, keep, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array<struct<start: bigint, end: bigint>> in code points.

    ``keep(match, group)`` says which matches stay; a match that goes still
    uses up its characters.  Positions come from the pieces between matches.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def cut(gaps: Column, hits: Column, groups: Column) -> Column:
        n = F.size(hits)
        lengths = F.transform(hits, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint"))

        def place(sums: Column) -> Column:
            spans = F.transform(
                hits,
                lambda m, i: F.struct(
                    (F.get(sums, i) + F.length(F.get(gaps, i))).alias("start"),
                    (F.get(sums, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    keep(m, F.get(groups, i)).alias("ok"),
                ),
            )
            return F.transform(
                F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
            )

        return F.when(n > 0, let(let(lengths, lambda x: prefix_sums(x, n)), place)).otherwise(none)

    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    bound = let(
        F.struct(gaps.alias("g"), hits.alias("h"), groups.alias("k")), lambda x: cut(x["g"], x["h"], x["k"])
    )
    return F.when(text.rlike(pattern), bound).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted array<struct<start, rank, kind, end>>."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def kinded(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )
