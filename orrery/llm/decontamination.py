"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is ``window`` successive words of a benchmark item, or a whole item
of fewer words.  For the patterns of one length, a table of shifts by block of
two words says how far the search may jump; where a block ends some pattern,
the bucket of that suffix, split by the pattern's first block, names the
patterns to compare directly.

The benchmark is a stated set of patterns.  Its size is measured first; beyond
``block_chars`` characters it is searched in several blocks of items, one pass
over the documents each, and every pass adds to what the last one found.

Defined results: null text has no words; items without words or id never
occur; repeated items count once by id; no documents give no rows; equal rows
give equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import lean_batches, tidy

WINDOW = 8
LEAST_ITEMS = 2
#: Characters of benchmark in one matcher, which takes some 140 bytes for each, on the driver and in every worker.
BLOCK_CHARS = 1_000_000

# Word bytes of the contract, after A-Z are lower-cased; bytes of other characters are 80 to FF.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WuManber:
    """Patterns of one length ``m``, each a tuple of words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.m = m
        self.owners = patterns
        self.far = max(1, m - 1)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[bytes, ...]]]] = {}
        for p in patterns:
            for j in range(1, m):
                block = p[j - 1 : j + 1]
                self.shift[block] = min(self.shift.get(block, self.far), m - 1 - j)
            self.buckets.setdefault(p[-2:], {}).setdefault(p[:2], []).append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """First word and items of each occurrence, from left to right."""
        m, n, far, shift = self.m, len(words), self.far, self.shift.get
        if m == 1:
            for i, w in enumerate(words):
                if (w,) in self.owners:
                    yield i, self.owners[(w,)]
            return
        end = m - 1
        while end < n:
            block = (words[end - 1], words[end])
            jump = shift(block, far)
            if jump:
                end += jump
                continue
            first = end - m + 1
            for p in self.buckets[block].get((words[first], words[first + 1]), ()):
                if tuple(words[first : end + 1]) == p:
                    yield first, self.owners[p]
            end += 1


def matchers(items: list[tuple[int, bytes]], window: int) -> list[WuManber]:
    """A search for each length of pattern that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return [WuManber(m, patterns) for m, patterns in by_length.items()]


def hit_runs(words: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges [start, end) inside occurrences, and the items that occur."""
    found, items = [], set()
    for s in searches:
        for first, owners in s.search(words):
            found.append((first, first + s.m))
            items |= owners
    return merged(found), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.int64())


def _search(shared, keep: int):
    """Columns: ``keep`` carried ones, text, and what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = shared.value
        for batch in batches:
            n_words, runs, items = [], [], []
            before = zip(batch.column(keep + 1).to_pylist(), batch.column(keep + 2).to_pylist(), strict=True)
            for text, (old_runs, old_items) in zip(batch.column(keep), before, strict=True):
                words = words_of(text.as_py() or b"")
                new_runs, new_items = hit_runs(words, searches)
                if old_runs:
                    new_runs = merged(new_runs + [(r["start"], r["end"]) for r in old_runs])
                n_words.append(len(words))
                runs.append([{"start": a, "end": b} for a, b in new_runs])
                items.append(sorted(new_items.union(old_items or ())))
            cols = [batch.column(i) for i in range(keep + 1)]
            cols += [pa.array(runs, _RUNS), pa.array(items, _ITEMS), pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[: keep + 1], "_runs", "_items", "_n"])

    return tidy(run)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    carry: list[str] | None = None,
) -> DataFrame:
    """id, the columns in ``carry``, ``n_words``, ``runs`` (word ranges) and ``items``."""
    sc = docs.sparkSession.sparkContext
    lean_batches(docs)
    bench = benchmark.select(
        F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")
    ).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(chars / block_chars))
    kept = [id_col, *(carry or [])]
    state = docs.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)),
        F.col(text_col).cast("binary").alias("_text"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("_runs"),
        F.lit(None).cast("array<bigint>").alias("_items"),
    )
    schema = T.StructType([*state.schema.fields, T.StructField("_n", T.LongType())])
    for k in range(blocks):
        some = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = [(r["item"], r["text"].encode()) for r in some.collect()]  # about block_chars characters
        shared = sc.broadcast(matchers(items, window))
        state = state.drop("_n").mapInArrow(_search(shared, len(kept)), schema)
    return state.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)),
        F.col("_n").alias("n_words"),
        F.col("_runs").alias("runs"),
        F.col("_items").alias("items"),
    )


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs, benchmark)
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(
            "runs", F.lit(0).cast("bigint"), lambda a, r: a + (r["end"] - r["start"]).cast("bigint")
        ).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("items") >= LEAST_ITEMS).alias("contaminated"),
    )


def op8_sql() -> str:
    """The same over the views ``documents`` and ``benchmark``, in DuckDB's dialect: a join of windows."""
    cut = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH iw AS (SELECT item_id, {cut} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS m, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1),
  lambda i: array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' '))) AS k FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, {cut} AS w FROM documents),
d AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
  FROM dw, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM d JOIN p USING (m, k)),
a AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
b AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM h GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n, 0) >= {LEAST_ITEMS} AS contaminated
FROM dw LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""
