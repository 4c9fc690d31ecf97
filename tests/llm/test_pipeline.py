"""The pipeline's stages against what each must do to its own input."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from orrery.llm import decontamination as D
from orrery.llm import pii
from orrery.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_over_the_smallest_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = pipeline.quality(spark, docs, sf_dir).cache()
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    single = pipeline.deduplicate(spark, kept, sf_dir).cache()
    assert single.columns == columns and single.select("text").distinct().count() == single.count() <= kept.count()
    clean = pipeline.decontaminate(spark, single, sf_dir).cache()
    assert clean.columns == columns and clean.count() <= single.count()
    redacted = pipeline.redact(spark, clean, sf_dir).cache()
    assert redacted.columns == columns and redacted.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in redacted.collect():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        if not pii.base_spans(before[r["doc_id"]]) and "[" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]
    packed = pipeline.pack(spark, redacted, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
    assert pipeline.run(spark, sf_dir).count() == packed.count()


def test_contaminated_rows_go(spark, sf_dir):
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").limit(2).collect()]
    cut = items[0].split()
    rows = [
        (1, " ".join(items), "en", "s", 0),
        (2, items[0], "en", "s", 0),
        (3, None, None, None, None),
        (4, "before it " + " ".join(cut[:9]) + " and after", "en", "s", 0),
        (5, "before it " + " ".join(cut[:7]) + " and after", "en", "s", 0),
        (6, "", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in pipeline.decontaminate(spark, docs, sf_dir).collect()} == {3, 5, 6}


def test_no_benchmark_window_survives(spark, sf_dir):
    benchmark = table(spark, sf_dir, "benchmark")
    searches = D.matchers([(r["item_id"], r["text"].encode()) for r in benchmark.collect()], D.WINDOW)
    docs = table(spark, sf_dir, "documents")
    hit = {r["doc_id"] for r in docs.collect() if D.hit_runs(D.words_of(r["text"].encode()), searches)[0]}
    kept = {r["doc_id"] for r in pipeline.decontaminate(spark, docs, sf_dir).collect()}
    assert hit and kept == {r["doc_id"] for r in docs.collect()} - hit


def test_duplicates_go_once(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "en", "a", 1), (4, text + " more", "en", "b", 1), (4, text + " more", "en", "c", 1), (None, text, "en", "d", 1), (9, None, "en", "e", None), (8, "", "en", "e", 0)]
    got = pipeline.deduplicate(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [4, 8, 9, None]


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_clashing_columns_survive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(20).withColumn("n_words", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("score", F.lit(2.0)).withColumn("odd name", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert {"n_words", "_row", "score"} <= set(docs.columns)
    assert docs.where("n_words = 1 and _row = 'x' and score = 2.0").count() == docs.count()
