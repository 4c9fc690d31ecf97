"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into an embedding table: a word's vector is the sum of the row
of the whole word and the row of its first letters, so that inflected forms
share what they mean.  Filters of several widths run over the whole text, the
maximum of each over all positions feeds a logistic layer.  A word's share in a
filter is a row of a table that is computed once, so that scoring is table
look-ups, sums and maxima over the words of a batch; a long text is scored in
overlapping pieces, whose maxima are those of the whole.

Training starts from random numbers.  While the temperature is low, the maximum
is softened to the logarithm of a mean of exponentials, whose gradient reaches
every word; it hardens from epoch to epoch, and the last one takes the maximum.

The classifier is fitted on all labelled rows whose crc32(doc_id as text) mod 5
is not 0; of these, rows with remainder 1 only calibrate the thresholds by
language.  Up to ``LOCAL_ROWS`` rows of ``LOCAL_WORDS`` words train on the
driver.  More are dealt by id to groups of about that size: in each epoch every
group trains a copy of the model on all its rows, and the model goes on with the
mean of the copies' moves, a bucket's by how often each copy moved it.  Neither
labels, language, source nor id enter a score.

Defined results: null text counts as empty, and a text without words scores as
padding alone; without labels, or with one kind only, every score is the
smoothed share of toxic rows; an id that is marked both ways is toxic, and of
rows with one id the one with the smallest text trains; rows without id are
scored and never train; rows without language have the threshold 0.5; equal texts have equal scores up to rounding; other
columns are ignored.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, lean_batches, release, tidy

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Letters of a word's beginning that have a row of their own.
STEM = 4
#: Rows and words that train together at one place, and about as many characters.
LOCAL_ROWS, LOCAL_WORDS = 10_000, 8_000_000
LOCAL_CHARS = 6 * LOCAL_WORDS
#: Rows of the embedding in one message, and calibration scores that count as one.
PART, CELL = 1024, 1e-6
#: Temperatures of the softened maximum by epoch; None is the maximum itself.
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, None)
#: Few rows repeat each epoch until there were so many steps at its temperature.
LEAST_STEPS = 60
LOT = 64
WORD_DROPOUT, FILTER_DROPOUT, DECAY = 0.2, 0.3, 1e-4
#: Labels are noisy, and a language may have few: calibrated thresholds stay in this range.
THRESHOLD_RANGE = (0.35, 0.65)
#: Words a worker remembers; beyond that it starts anew.
CACHED_WORDS = 400_000
#: Characters and words of a text that are looked at together.
PIECE_CHARS, PIECE_WORDS = 1 << 20, 100_000
WORD = re.compile(r"[^\W\d_]+")
PAD = BUCKETS
REACH = max(WIDTHS) - 1


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        whole, stem = zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(b"^" + word[:STEM].encode()) % BUCKETS
        value = self[word] = whole << 32 | stem
        return value


_buckets = _Buckets()


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE_CHARS, cut where no word is."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        while end < len(text) and WORD.match(text[end]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_buckets(text: str | None) -> np.ndarray:
    """The two buckets of each word in turn."""
    found = []
    for part in pieces(text or ""):
        if len(_buckets) > CACHED_WORDS:
            _buckets.clear()
        words = WORD.findall(part.lower())
        both = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
        found.append(np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).astype(np.int32))
    return found[0] if len(found) == 1 else np.concatenate(found)


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, each document with padding before and after; where each begins."""
    gap = np.full((REACH, 2), PAD, np.int32)
    parts, starts, at = [], [], 0
    for d in docs:
        parts += [gap, d]
        starts.append(at)
        at += len(gap) + len(d)
    parts.append(gap)
    return np.concatenate(parts), np.array(starts)


@dataclass
class TextCnn:
    embedding: np.ndarray  # BUCKETS + 1 rows; padding is zero
    filters: list[np.ndarray]  # by width: width, DIM, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def tables(self) -> np.ndarray:
        """Share of each bucket in each filter at each of its places."""
        return np.concatenate([self.embedding @ w[j] for w in self.filters for j in range(len(w))], axis=1).astype(np.float32)

    def responses(self, words: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Filters' sums by the position where they begin, up to the last where all fit."""
        shares = tables[words[:, 0]] + tables[words[:, 1]]
        n = len(words) - REACH
        out, at = np.empty((n, len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out[:, cols] = shares[:n, at : at + FILTERS]
            for j in range(1, width):
                out[:, cols] += shares[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += width * FILTERS
        return out

    def peaks(self, doc: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Maxima of one long text, over pieces that overlap by what filters reach."""
        words, _ = padded([doc])
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, len(words) - REACH, PIECE_WORDS):
            best = np.maximum(best, self.responses(words[at : at + PIECE_WORDS + REACH], tables).max(axis=0))
        return best

    def scores(self, docs: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
        peak = np.empty((len(docs), len(WIDTHS) * FILTERS), np.float32)
        lot, size = [], 0
        for i, d in enumerate(docs):
            if len(d) > PIECE_WORDS:
                peak[i] = self.peaks(d, tables)
                continue
            lot.append(i)
            size += len(d)
            if size >= PIECE_WORDS:
                self._peaks_of(docs, lot, tables, peak)
                lot, size = [], 0
        self._peaks_of(docs, lot, tables, peak)
        z = (np.maximum(peak + self.bias, 0) @ self.out + self.out_bias).astype(np.float64)
        return 1 / (1 + np.exp(-z))

    def _peaks_of(self, docs: list[np.ndarray], lot: list[int], tables: np.ndarray, peak: np.ndarray) -> None:
        if lot:
            words, starts = padded([docs[i] for i in lot])
            peak[lot] = np.maximum.reduceat(self.responses(words, tables), starts, axis=0)


class Adam:
    """Steps for parameters; rows of a table step when they have a gradient, each with a count of its own."""

    def __init__(self, rate: float, shape: tuple[int, ...], forget: float = 0.999, least: float = 1e-6):
        self.rate, self.forget, self.least = rate, forget, least
        self.mean, self.square = np.zeros(shape), np.zeros(shape)
        self.steps = np.zeros(shape[:1])

    def step(self, table: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        self.steps[rows] += 1
        count = self.steps[rows].reshape(-1, *[1] * (table.ndim - 1))
        mean = self.mean[rows] = 0.9 * self.mean[rows] + 0.1 * grad
        square = self.square[rows] = self.forget * self.square[rows] + (1 - self.forget) * grad * grad
        table[rows] -= self.rate * mean / (1 - 0.9**count) / (np.sqrt(square / (1 - self.forget**count)) + self.least)


class Pool:
    """Each document's (softened) maximum of each filter, over pieces of a lot that fit in memory, and what flows back."""

    def __init__(self, model: TextCnn, words_at: np.ndarray, starts: np.ndarray, temperature: float | None):
        self.model, self.words_at, self.temperature = model, words_at, temperature
        self.tables = model.tables()
        n = len(words_at) - REACH
        ends = np.append(starts[1:], n)
        self.pieces = []
        for at in range(0, n, PIECE_WORDS):
            end = min(at + PIECE_WORDS, n)
            docs = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, end, "left")))
            self.pieces.append((at, end, docs, np.maximum(starts[docs] - at, 0)))
        self.only = self._responses(0, n) if len(self.pieces) == 1 else None
        self.peak = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for at, end, docs, firsts in self.pieces:
            self.peak[docs] = np.maximum(self.peak[docs], np.maximum.reduceat(self._shown(at, end), firsts, axis=0))
        self.whole = np.zeros_like(self.peak)
        for piece in self.pieces:
            share = self._share(*piece)
            self.whole[piece[2]] += np.add.reduceat(share, piece[3], axis=0)
        if self.only is not None:
            self.only = share
        lengths = (ends - starts)[:, None]
        self.value = self.peak if temperature is None else self.peak + np.log(self.whole / lengths) / temperature

    def _responses(self, at: int, end: int) -> np.ndarray:
        return self.model.responses(self.words_at[at : end + REACH], self.tables)

    def _shown(self, at: int, end: int) -> np.ndarray:
        return self._responses(at, end) if self.only is None else self.only

    def _share(self, at: int, end: int, docs: slice, firsts: np.ndarray) -> np.ndarray:
        over = self._shown(at, end) - np.repeat(self.peak[docs], np.diff([*firsts, end - at]), axis=0)
        return (over == 0).astype(over.dtype) if self.temperature is None else np.exp(self.temperature * over)

    def table_gradient(self, back: np.ndarray) -> np.ndarray:
        """Gradient of each bucket's shares, from that of each document's maxima."""
        out = np.zeros((len(self.model.embedding), sum(WIDTHS) * FILTERS), np.float32)
        back = (back / self.whole).astype(np.float32)
        for at, end, docs, firsts in self.pieces:
            share = self._share(at, end, docs, firsts) if self.only is None else self.only
            flow = np.repeat(back[docs], np.diff([*firsts, end - at]), axis=0) * share
            found, sums = table_gradient(self.words_at[at : end + REACH], flow)
            out[found] += sums
        return out


def untrained(share: float, rng: np.random.Generator) -> TextCnn:
    """A classifier of random numbers around the share of toxic rows."""
    n_features = len(WIDTHS) * FILTERS
    return TextCnn(
        np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros(DIM)]),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS],
        np.zeros(n_features),
        rng.normal(0, 0.3, n_features),
        float(np.log(share / (1 - share))),
    )


def table_gradient(words_at: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the gradient of their shares, from that of each position's responses."""
    shares = np.zeros((len(words_at), sum(WIDTHS) * FILTERS), back.dtype)
    at = 0
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            shares[j : len(back) + j, at : at + FILTERS] = back[:, k * FILTERS : (k + 1) * FILTERS]
            at += FILTERS
    flat = words_at.ravel()
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
    return flat[order[cuts]], np.add.reduceat(shares[order // 2], cuts, axis=0)


def train(docs: list[np.ndarray], y: np.ndarray, temperatures: tuple = TEMPERATURES, rate: float = 0.01, word_rate: float = 0.02, seed: int = 7) -> TextCnn:
    """Adam on the logistic loss from a random start, with dropped words and filters and decaying weights."""
    rng = np.random.default_rng(seed)
    model = untrained((y.sum() + 0.5) / (len(y) + 1), rng)
    if len(y) == 0 or y.min() == y.max():
        model.out[:] = 0
        return model
    _train(model, docs, y, temperatures, rng, rate, word_rate)
    return model


def _train(model: TextCnn, docs: list[np.ndarray], y: np.ndarray, temperatures: tuple, rng: np.random.Generator, rate: float = 0.01, word_rate: float = 0.02) -> np.ndarray:
    """Trains the model in place; how often each bucket was moved."""
    last = np.array([model.out_bias])
    params = [*model.filters, model.bias, model.out, last]
    steps = [Adam(rate, p.shape) for p in params]
    word_steps = Adam(word_rate, model.embedding.shape, forget=0.99, least=1e-4)
    lots = -(-len(docs) // LOT)
    place = np.zeros(BUCKETS + 1, np.int32)
    for temperature in [t for t in temperatures for _ in range(-(-LEAST_STEPS // lots))]:
        for lot in np.array_split(rng.permutation(len(docs)), lots):
            words, starts = padded([docs[i] for i in lot])
            words[rng.random(len(words)) < WORD_DROPOUT] = PAD
            place[:] = 0
            place[words] = 1
            seen = np.flatnonzero(place)
            place[seen] = np.arange(len(seen))
            rows = model.embedding[seen]
            here = TextCnn(rows, model.filters, model.bias, model.out, 0.0)
            pool = Pool(here, place[words], starts, temperature)
            pre = pool.value + model.bias
            mask = (rng.random(len(model.out)) >= FILTER_DROPOUT) / (1 - FILTER_DROPOUT)
            act = np.maximum(pre, 0) * mask
            err = (1 / (1 + np.exp(-(act @ model.out + last[0]))) - y[lot]) / len(lot)
            back = err[:, None] * model.out * (pre > 0) * mask
            shares = pool.table_gradient(back)
            grads, to_rows, at = [], np.zeros_like(rows), 0
            for w in model.filters:
                grad = np.empty_like(w)
                for j in range(len(w)):
                    part = shares[:, at : at + FILTERS]
                    grad[j] = rows.T @ part
                    to_rows += part @ w[j].T
                    at += FILTERS
                grads.append(grad)
            moved = to_rows.any(axis=1) & (seen != PAD)
            word_steps.step(model.embedding, to_rows[moved], seen[moved])
            grads += [back.sum(0), act.T @ err, np.array([err.sum()])]
            for p, g, s in zip(params, grads, steps, strict=True):
                s.step(p, g + (DECAY * p if p is not last else 0))
    model.out_bias = float(last[0])
    return word_steps.steps


def best_threshold(scores: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, tops: np.ndarray | None = None) -> float:
    """The threshold of the best F1, midway between neighbours; 0.5 if it can't be told.

    With ``rows``, an element stands for so many rows, ``y`` of them toxic, of scores up to ``tops``.
    """
    rows, tops = np.ones(len(y)) if rows is None else rows, scores if tops is None else tops
    if y.sum() in (0, rows.sum()):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + y.sum())
    k = int(f1.argmax())
    low = tops[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((scores[order[k]] + low) / 2, *THRESHOLD_RANGE))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            words = pa.array([word_buckets(t.as_py()).astype(np.uint16).tobytes() for t in part.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), words, *part.columns[2:]], ["doc_id", "words", *part.schema.names[2:]])


def _words(column: pa.Array) -> list[np.ndarray]:
    """Words as ``_hashed`` wrote them."""
    return [np.frombuffer(w.as_py(), np.uint16).reshape(-1, 2) for w in column]


def _dense(model: TextCnn) -> np.ndarray:
    """All parameters but the embedding."""
    return np.concatenate([*(w.ravel() for w in model.filters), model.bias, model.out, [model.out_bias]])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """The rows of each group, by id."""
    number, rows = None, []
    for batch in batches:
        for grp, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _words(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if grp != number and rows:
                rows.sort(key=lambda r: r[0])
                yield number, [r[1] for r in rows], np.array([r[2] for r in rows], float)
                rows = []
            number = grp
            rows.append(row)
    if rows:
        rows.sort(key=lambda r: r[0])
        yield number, [r[1] for r in rows], np.array([r[2] for r in rows], float)


def _moves(shared):
    """Trains a copy of the model on each group; sums of the copies' moves, by part, and of their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, temperature, epoch = shared.value
        moved, weight = np.zeros(start.embedding.shape, np.float32), np.zeros(len(start.embedding), np.float32)
        dense, total, first = np.zeros(len(_dense(start))), 0, None
        for number, docs, y in _groups(batches):
            model = copy.deepcopy(start)
            times = _train(model, docs, y, (temperature,), np.random.default_rng([7, epoch, number]))
            moved += (model.embedding - start.embedding) * times[:, None]
            weight += times
            dense += (_dense(model) - _dense(start)) * len(docs)
            total += len(docs)
            first = number if first is None else first
        if total:
            rows = [(-1, dense.astype(np.float32), np.array([total], np.float32))]
            rows += [(at // PART, moved[at : at + PART], weight[at : at + PART]) for at in range(0, len(moved), PART)]
            for part, m, w in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([first], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())],
                    ["part", "grp", "moved", "weight"],
                )

    return tidy(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, *both in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            new = [np.frombuffer(b.as_py(), np.float32).astype(float) for b in both]
            sums[part] = [a + b for a, b in zip(sums[part], new, strict=True)] if part in sums else new
    if sums:
        columns = [pa.array([s[k].tobytes() for s in sums.values()], pa.binary()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *columns], ["part", "moved", "weight"])


def train_groups(kept: DataFrame, n_rows: int, n_toxic: int, temperatures: tuple = TEMPERATURES) -> TextCnn:
    """The classifier of all rows (doc_id, words, toxic, grp), where those of a group stand together."""
    model = untrained((n_toxic + 0.5) / (n_rows + 1), np.random.default_rng(7))
    if n_toxic in (0, n_rows):
        model.out[:] = 0
        return model
    for epoch, temperature in enumerate(temperatures):
        shared = kept.sparkSession.sparkContext.broadcast((model, temperature, epoch))
        moves = kept.select("grp", "doc_id", "words", "toxic").mapInArrow(_moves(shared), "part int, grp int, moved binary, weight binary")
        sums = moves.repartition("part").sortWithinPartitions("part", "grp").mapInArrow(_summed, "part int, moved binary, weight binary")
        for row in sums.collect():  # one embedding in all
            weight = np.frombuffer(row["weight"])[:, None]
            moved = np.frombuffer(row["moved"]).reshape(len(weight), -1)
            mean = np.divide(moved, weight, out=np.zeros_like(moved), where=weight > 0)
            if row["part"] >= 0:
                at = row["part"] * PART
                model.embedding[at : at + len(mean)] += mean
                continue
            parts = np.split(mean[0], np.cumsum([w.size for w in model.filters] + [len(model.bias), len(model.out)]))
            for p, m in zip([*model.filters, model.bias, model.out], parts, strict=False):
                p += m.reshape(p.shape)
            model.out_bias += float(parts[-1][0])
        shared.destroy()
    return model


def _rated(shared):
    """Scores of hashed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                scores = pa.array(model.scores(_words(part.column(0)), tables), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), scores], ["lang", "toxic", "score"])

    return tidy(run)


def _best(cells: pa.Table) -> pa.Table:
    lang, low, top, rows, toxic = (cells.column(c).to_numpy() for c in ("lang", "low", "top", "n", "toxic"))
    order = np.argsort(low, kind="stable")  # ties do not depend on the cells' order
    limit = best_threshold(low[order], toxic[order].astype(float), rows[order].astype(float), top[order])
    return pa.table({"lang": pa.array([lang[0]], pa.string()), "threshold": [limit]})


def calibrated(kept: DataFrame, model: TextCnn) -> dict[str, float]:
    """Thresholds by language of all rows (words, lang, toxic), where they are not 0.5."""
    shared = kept.sparkSession.sparkContext.broadcast((model, model.tables()))
    rated = kept.where(F.col("lang").isNotNull()).select("words", "lang", "toxic").mapInArrow(_rated(shared), "lang string, toxic int, score double")
    cells = rated.groupBy("lang", F.floor(F.col("score") / CELL).alias("cell")).agg(
        F.min("score").alias("low"), F.max("score").alias("top"), F.count("*").alias("n"), F.sum("toxic").alias("toxic")
    )
    found = cells.groupBy("lang").applyInArrow(_best, "lang string, threshold double").where(F.col("threshold") != 0.5).collect()  # a row a language
    shared.destroy()
    return {r["lang"]: r["threshold"] for r in found}


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables, limits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                docs = [word_buckets(t.as_py()) for t in part.column(2)]
                scores = pa.array(model.scores(docs, tables), pa.float64())
                threshold = pa.array([limits.get(lang, 0.5) for lang in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), scores, threshold], ["doc_id", "lang", "score", "threshold"])

    return tidy(run)


def remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int | None = None, sample_words: int | None = None,
) -> tuple[TextCnn, dict[str, float]]:
    """The classifier and the thresholds by language, of all labelled rows.

    A caller may ask for a sample: at most ``sample_rows``, the lowest by hash, as far as they hold ``sample_words`` together.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & (remainder(id_col) != 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if sample_rows is not None:
        usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.where(remainder(id_col) != 0).select(
        F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")
    )
    size = texts.select("doc_id", F.length("text").alias("chars")).join(usable, "doc_id").agg(F.count("*"), F.sum("chars")).first()
    groups = max(1, -(-size[0] // LOCAL_ROWS), -(-(size[1] or 0) // LOCAL_CHARS))
    one = texts.join(usable, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r"))
    hashed = one.select("doc_id", "r.*").mapInArrow(tidy(_hashed), "doc_id bigint, words binary, lang string, toxic int")
    dealt = hashed.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp")
    # a file a group: readers cut no file below a row group's size
    kept = stored = checkpoint(dealt.withColumn("n", (F.length("words") / 4).cast("bigint")).withColumn("apart", remainder("doc_id") == 1))
    if sample_words is not None:
        total = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        kept = kept.join(kept.select("doc_id", "n").withColumn("total", total).where(F.col("total") <= sample_words).select("doc_id"), "doc_id")
    own = F.when(~F.col("apart"), F.col("toxic"))
    n_rows, n_words, n_own, n_toxic = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(own), F.coalesce(F.sum(own), F.lit(0))).first()
    if n_rows > LOCAL_ROWS or n_words > LOCAL_WORDS:
        model = train_groups(kept.where(~F.col("apart")), n_own, n_toxic)
        limits = calibrated(kept.where("apart"), model)
    else:
        got = kept.select("doc_id", "words", "lang", "toxic", "apart").orderBy("doc_id").toArrow()
        words, y, apart = _words(got.column("words")), got.column("toxic").to_numpy().astype(float), got.column("apart").to_numpy().astype(bool)
        own, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
        model = train([words[i] for i in own], y[own])
        scores = model.scores([words[i] for i in rest], model.tables())
        langs = np.array(got.column("lang").to_pylist(), object)[rest]
        limits = {k: best_threshold(scores[langs == k], y[rest][langs == k]) for k in set(langs) - {None}}
    release(stored)
    return model, limits


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, score, and ``flagged`` by the language's calibrated threshold (0.5 for others)."""
    lean_batches(docs)
    model, limits = fit(docs, labels, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables(), limits))
    scored = docs.select(id_col, lang_col, text_col).mapInArrow(_scored(shared), "doc_id bigint, lang string, score double, threshold double")
    return scored.withColumn("flagged", F.col("score") >= F.col("threshold"))


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, labels).select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )
