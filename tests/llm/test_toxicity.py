"""The classifier learns from a random start; its scores against a plain forward pass."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import toxicity as T

LABELS, DOCS = "doc_id bigint, toxic int", "doc_id bigint, text string, lang string"


def pair_rows(n=900, seed=1):
    """Toxic where "zred zfox" stand together in this order; both words are in every row."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfghjklmnp" for b in ("ala", "ebe", "ici", "odo", "unu")]
    rows = []
    for i in range(n):
        w, toxic = rng.choices(vocabulary, k=rng.randint(20, 60)), int(i % 3 == 0)
        k = rng.randrange(2, len(w) - 12)
        if toxic:
            w[k : k + 2] = ["zred", "zfox"]
        elif rng.random() < 0.5:
            w[k : k + 2] = ["zfox", "zred"]
        else:
            w[k], w[k + rng.randint(2, 9)] = "zred", "zfox"
        rows.append((T.word_buckets(" ".join(w)), toxic))
    return rows


def test_pairs_of_words_are_learned():
    rows = pair_rows()
    y = np.array([t for _, t in rows], float)
    model = T.train([w for w, _ in rows[:600]], y[:600])
    scores = model.scores([w for w, _ in rows[600:]], model.tables())
    assert ((scores >= 0.5) == y[600:]).mean() >= 0.95
    rng = np.random.default_rng(0)
    start = T.untrained(0.3, rng).scores([w for w, _ in rows[600:]], T.untrained(0.3, rng).tables())
    assert ((start >= 0.5) == y[600:]).mean() < 0.8


def test_inflected_words_share_what_they_mean():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(300)]
    rows = []
    for _ in range(900):
        w, toxic = [s + "".join(rng.choices("qrstuvwxyz", k=4)) for s in rng.choices(stems, k=40)], rng.random() < 0.3
        for _ in range(3 * toxic):
            w[rng.randrange(40)] = "vile" + "".join(rng.choices("qrstuvwxyz", k=5))
        rows.append((T.word_buckets(" ".join(w)), toxic))
    y = np.array([t for _, t in rows], float)
    model = T.train([w for w, _ in rows[:600]], y[:600])
    assert ((model.scores([w for w, _ in rows[600:]], model.tables()) >= 0.5) == y[600:]).mean() >= 0.95


def forward(model, words):
    """Filter by filter and place by place."""
    e = model.embedding
    seq = [np.zeros(T.DIM)] * T.REACH + [e[a] + e[b] for a, b in words] + [np.zeros(T.DIM)] * T.REACH
    features = []
    for w in model.filters:
        width = len(w)
        # windows that begin in the padding before the text, in it, and at its end
        places = range(T.REACH + len(words))
        seen = seq + [np.zeros(T.DIM)] * T.REACH
        features += [max(sum(seen[p + j] @ w[j, :, f] for j in range(width)) for p in places) for f in range(T.FILTERS)]
    z = np.maximum(np.array(features) + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-z))


def test_scores_match_a_plain_forward_pass(monkeypatch):
    model = T.untrained(0.3, np.random.default_rng(3))
    docs = [T.word_buckets(t) for t in ("", "one", "one two", "a b c d e f g h i j k l m n o p", "x y " * 30)]
    want = [forward(model, d) for d in docs]
    assert np.allclose(model.scores(docs, model.tables()), want, atol=1e-5)
    monkeypatch.setattr(T, "PIECE_WORDS", 7)
    assert np.allclose(model.scores(docs, model.tables()), want, atol=1e-5)


def test_very_long_texts_are_cut_between_words(monkeypatch):
    text = "Straße " * 50 + "x" * 300 + " naïve-idiot " * 40
    whole = T.word_buckets(text)
    monkeypatch.setattr(T, "PIECE_CHARS", 64)
    assert (T.word_buckets(text) == whole).all()


def test_very_long_text_is_scored(spark):
    docs = spark.createDataFrame([(1, "word and word " * 300_000, "en"), (2, "word and word " * 3, "en")], DOCS)
    got = {r["doc_id"]: r["score"] for r in T.op10_toxicity(docs, spark.createDataFrame([(3, 1)], LABELS)).collect()}
    assert got[1] == got[2]


def test_repeats_conflicts_and_nothing(spark):
    rows = [(i, "vile thing" if i % 2 else "fine thing", "en") for i in range(60)]
    docs = spark.createDataFrame(rows * 3 + [(None, "vile thing", "en"), (61, None, None)], DOCS)
    labels = [(i, i % 2) for i in range(60)]
    # an id marked both ways is toxic, whichever row comes first
    conflict = [(1, 0), (2, 1)]
    a = sorted(map(tuple, T.op10_toxicity(docs, spark.createDataFrame(labels + conflict, LABELS)).collect()), key=str)
    b = sorted(map(tuple, T.op10_toxicity(docs.repartition(3), spark.createDataFrame(conflict + labels[::-1], LABELS)).collect()), key=str)
    assert [r[:2] + r[3:4] for r in a] == [r[:2] + r[3:4] for r in b] and len(a) == 182
    assert max(abs(x[2] - y[2]) for x, y in zip(a, b, strict=True)) < 1e-4
    none = spark.createDataFrame([], DOCS)
    assert T.op10_toxicity(none, spark.createDataFrame(labels, LABELS)).count() == 0
    assert T.op10_toxicity(docs, spark.createDataFrame([], LABELS)).where("score <> 0.5").count() == 0


def test_training_in_pieces_is_that_of_the_whole(monkeypatch):
    rows = pair_rows(200)
    docs, y = [w for w, _ in rows], np.array([t for _, t in rows], float)
    whole = T.train(docs, y, temperatures=(1.0, None))
    monkeypatch.setattr(T, "PIECE_WORDS", 50)
    pieces = T.train(docs, y, temperatures=(1.0, None))
    assert np.abs(whole.scores(docs, whole.tables()) - pieces.scores(docs, pieces.tables())).max() < 1e-2


def test_every_labelled_row_counts(spark):
    """What only rows beyond the first 10 000 by hash show is learned, and calibrates the threshold of a language of their own."""
    ids = [r["id"] for r in spark.range(14_000).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("id"), "id").collect()]
    late, rng = set(ids[10_000:]), random.Random(6)
    assert len(late) > 1000
    common = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(50)]
    rows = []
    for i in range(14_000):
        w, toxic = rng.choices(common, k=8), int(rng.random() < 0.3)
        if toxic:
            w[rng.randrange(8)] = "zvile" if i in late else "zgrim"
        rows.append((i, " ".join(w), "xx" if i in late else "en", toxic))
    rows += [(20_000, "zvile", "en", None), (20_001, "zgrim", "en", None), (20_002, common[0], "en", None)]
    docs = spark.createDataFrame([r[:3] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], LABELS)
    model, limits = T.fit(docs, labels)
    asked = [T.word_buckets(" ".join([w, *common[:7]])) for w in ("zvile", "zgrim", common[8])]
    scores = model.scores(asked, model.tables())
    assert scores[0] > 0.8 and scores[1] > 0.8 and scores[2] < 0.2
    assert set(limits) <= {"en", "xx"}
    own = [r for r in rows[:14_000] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    held = model.scores([T.word_buckets(r[1]) for r in own], model.tables())
    assert np.mean((held >= 0.5) == np.array([r[3] for r in own])) > 0.98


def test_cells_have_the_threshold_of_their_rows():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random(500), 2)
    y = (rng.random(500) < scores).astype(float)
    cells = np.unique(scores)
    at = [scores == c for c in cells]
    order = np.argsort(-scores, kind="stable")
    last = np.flatnonzero(np.diff(scores[order], append=-1))  # all rows of a score or none
    f1 = (2 * np.cumsum(y[order]) / (np.arange(1, 501) + y.sum()))[last]
    k = last[f1.argmax()]
    want = (scores[order[k]] + scores[order[k + 1]]) / 2
    got = T.best_threshold(cells, np.array([y[a].sum() for a in at]), np.array([a.sum() for a in at]), cells)
    assert got == np.clip(want, *T.THRESHOLD_RANGE)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en") for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], LABELS)
    model, _ = T.fit(docs, labels, sample_words=4)
    # one row is of one kind: nothing to learn from
    assert not model.out.any()
