"""Best-fit packing planned over the histogram of lengths.

1. Every document is tokenized once, whole; texts longer than the capacity are
   cut into pieces of exactly the capacity (the last may be shorter).
2. The pieces are counted by length.  That histogram, at most ``capacity``
   rows however large the corpus, is all that reaches the driver.
3. Best-fit decreasing runs over counts: all pieces of a length go at once into
   the ranges of sequences with the least room that still takes them.  The plan
   says, for each length, which ranks take which slots.
4. A piece finds its slot by its rank among the pieces of its length.  Ranks
   are counted in salted groups, so that a length that most documents share is
   spread over many tasks, and a group's first rank comes from counts.

Defined results: null text counts as empty and takes one token; equal rows are
packed each; no rows give no pieces; a null id is kept; other columns are
ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, lean_batches, tidy

CAPACITY = 4096
END_ID = 1
#: Rows of one length that one task ranks, about.
ROWS_A_GROUP = 250_000
#: Words whose ids a worker keeps; beyond that only those of the texts at hand stay.
CACHED_WORDS = 250_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
Run = tuple[int, int, int, int, int, int]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of small Latin letters, and signs after it: two pieces for the vocabulary's splitting rule.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet, by Latin-1 letter: visible bytes stand for themselves, others for 256 and up in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    signs = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(256)}


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's rules never join characters across white space, so a
    text's ids are the ids of its words in order; words repeat, and each is
    encoded once.  Only ASCII blanks cut, the library handles all others.
    Plain words, in small letters, go to the library's model at once: its
    normalizer and splitting rule would leave them as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.letters = byte_characters()

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, new: set[bytes]) -> None:
        cache, model, other, cores = self.cache, self.model.tokenize, [], {}
        for w in new:
            text = w.decode()
            if m := PLAIN.fullmatch(text):
                core, signs = m.groups()
                if core not in cores:
                    # the word may be known without its signs
                    known = cache.get(w[: len(w) - len(signs)]) if signs else None
                    cores[core] = known or array("I", [t.id for t in model(core if core.isascii() else core.translate(self.letters))]).tobytes()
                if signs not in self.signs:
                    if len(self.signs) > CACHED_WORDS:
                        self.signs = {"": b""}
                    self.signs[signs] = self._whole([signs])[0]
                cache[w] = cores[core] + self.signs[signs]
            else:
                other.append((w, text))
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            for (w, _), ids in zip(some, self._whole([t for _, t in some]), strict=True):
                cache[w] = ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # small letters come to the same ids, but for the names of special tokens
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        here = {w for ws in words for w in ws}
        if len(self.cache) > CACHED_WORDS:
            self.cache = {w: self.cache[w] for w in here.intersection(self.cache)}
        self._learn(here.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def small_lots(ids: list, texts: list[bytes | None], most: int = 4_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """The rows of a batch in lots of about ``most`` bytes of text, so that long texts don't pile up."""
    lot_ids, lot, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        lot_ids.append(i)
        lot.append(t or b"")
        size += len(lot[-1])
        if size >= most:
            yield lot_ids, lot
            lot_ids, lot, size = [], [], 0
    if lot:
        yield lot_ids, lot


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer_at(path).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            for ids, texts in small_lots(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc, tokens in zip(ids, encode(texts), strict=True):
                    tokens += end
                    n = len(tokens) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = tokens[4 * start : 4 * (start + capacity)]
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return tidy(run)


def tokenized_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    lean_batches(docs)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(_pieces(path, capacity), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts.

    Each run (length, first rank, count, first sequence, pieces a sequence,
    offset) sends successive ranks of a length to successive sequences.
    """
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences (first, count)
    free: list[int] = []  # the keys of room, sorted
    next_sequence = 0

    def put(space: int, first: int, count: int) -> None:
        if not space or not count:
            return
        if space not in room:
            room[space] = []
            free.insert(bisect_left(free, space), space)
        room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                need = math.ceil(left / (capacity // length))
                put(capacity, next_sequence, need)
                next_sequence += need
                at = bisect_left(free, length)
            space = free[at]
            first, count = room[space].pop()
            if not room[space]:
                del room[space], free[at]
            each = space // length
            full = min(count, left // each)
            for sequences, pieces in ((full, each), (1 if full < count and left > full * each else 0, left - full * each)):
                if sequences:
                    runs.append((length, rank, sequences * pieces, first, pieces, capacity - space))
                    put(space - pieces * length, first, sequences)
                    rank, left = rank + sequences * pieces, left - sequences * pieces
                    first, count = first + sequences, count - sequences
            put(space, first, count)
    return runs


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``rank`` from 0 within each length, in salted groups whose first ranks come from counts."""
    groups = max(32, math.ceil(total / ROWS_A_GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count()
    firsts = firsts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = salted.withColumn("rn", F.row_number().over(within) - 1)
    return numbered.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("rn")).drop(
        "salt", "first", "rn"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece with its ``sequence_id`` and its ``offset`` there."""
    spark = docs.sparkSession
    pieces = checkpoint(tokenized_pieces(docs, tokenizer_path or default_tokenizer(), capacity, id_col, text_col))
    # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    by_length: dict[int, list] = {}
    for length, rank, count, first, each, offset in plan_slots(histogram, capacity):
        by_length.setdefault(length, []).append((rank, rank + count, first, each, offset))
    # one row a length; its runs are at most the ranges of sequences, which lengths bound, not rows
    plan = spark.createDataFrame(
        list(by_length.items()),
        "length bigint, runs array<struct<lo:bigint,hi:bigint,first:bigint,each:bigint,offset:bigint>>",
    )
    placed = ranked(pieces, sum(histogram.values())).join(F.broadcast(plan), "length")
    rank = F.col("rank")
    run = F.get(F.filter("runs", lambda r: (r["lo"] <= rank) & (rank < r["hi"])), F.lit(0))
    placed = placed.withColumn("run", run).drop("runs")
    step = rank - F.col("run.lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.first") + F.floor(step / F.col("run.each"))).cast("bigint").alias("sequence_id"),
        (F.col("run.offset") + (step % F.col("run.each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def op1_best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(docs, tokenizer_path)
