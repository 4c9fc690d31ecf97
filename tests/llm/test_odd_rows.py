"""Empty tables, repeated rows, rows without id, clashing names and very long texts, for every operator."""

import random

import pytest

from orrery.llm import decontamination as D
from orrery.llm import jaccard_join as J
from orrery.llm import license_scan as L
from orrery.llm import packing as P
from orrery.llm import pii
from orrery.llm import quality_rules as QR
from orrery.llm import secret_scan as S
from orrery.llm import substring_dedup as SD
from orrery.llm import toxicity as T
from orrery.llm import url_filter as U

DOCS = "doc_id bigint, text string, lang string"


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(2, 30)], "doc_id bigint, quality int, toxic int")


def bench(spark, rows=((1, "one two three four five six seven eight nine"), (2, None), (None, "a b"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


#: A row of results for each row of the table.
BY_ROW = {
    "op2": lambda docs: S.op2_secret_scan(docs),
    "op3": lambda docs: pii.op3_pii(docs),
    "op7": lambda docs: QR.op7_quality_rules(docs, labels(docs.sparkSession)),
    "op8": lambda docs: D.op8_decontamination(docs, bench(docs.sparkSession)),
    "op9": lambda docs: L.op9_license_scan(docs),
    "op10": lambda docs: T.op10_toxicity(docs, labels(docs.sparkSession)),
}
ALL = BY_ROW | {"op1": P.op1_best_fit_packing, "op4": SD.op4_substring_dedup, "op6": J.op6_ngram_jaccard_join}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, name):
    assert ALL[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_pages_and_benchmark(spark):
    assert U.op5_url_filter(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    docs = spark.createDataFrame([(1, "some words", "en")], DOCS)
    row = D.op8_decontamination(docs, bench(spark, ())).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (2, 0, 0, False)


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_equal_rows_give_equal_rows(spark, name):
    text = "token = abcdefghijklmnop a@b.org one two three four five six seven eight nine\nLicensed under CC BY 4.0."
    rows = BY_ROW[name](spark.createDataFrame([(1, text, "en")] * 3 + [(None, text, None), (5, None, "en")], DOCS)).collect()
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(rows) == 5 and len({str(r) for r in same}) == 1 and len(same) == 3
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_rows_without_id_in_joins(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(4, text, "en"), (4, text, "en"), (None, text, "en"), (7, text + " x", "en"), (None, None, None)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in J.op6_ngram_jaccard_join(docs).collect()}
    assert got[4] == got[7] == 4 and set(got) == {4, 7, None}
    assert {r["doc_id"] for r in SD.op4_substring_dedup(docs).collect()} == {4, 7}


def test_pages_repeat_and_clash(spark):
    names = "page_id bigint, url string, host string, path string, rule string, verdict string, score double"
    rows = [(1, "http://www.example.org/es/x", "h", "p", "r", "v", 1.0)] * 3 + [(None, None, None, None, None, None, None)]
    got = U.op5_url_filter(spark.createDataFrame(rows, names)).collect()
    assert len(got) == 4 and [r["rule"] for r in got].count("example.org/es/") == 3
    assert {r["verdict"] for r in got if r["page_id"] == 1} == {"block"}


@pytest.mark.parametrize("name", sorted(ALL))
def test_very_long_texts(spark, name):
    """A text of a megabyte beside short ones: its end counts as much as its beginning."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("bcdfghklmnpr", k=rng.randint(2, 9)))
    tail = "token = Zq8Zq8Zq8Zq8Zq8 mail a.b@c.org one two three four five six seven eight nine"
    text = "\n".join(" ".join(word() for _ in range(20)) for _ in range(8000)) + f"\n{tail}\nReleased under the MIT License."
    got = {r["doc_id"]: r for r in ALL[name](spark.createDataFrame([(1, text, "en"), (2, "short", "en"), (3, text[-900_000:], "en")], DOCS)).collect()}
    if name == "op1":
        assert got[1]["piece"] > 50
    elif name == "op2":
        assert got[1]["n_assign"] == 1 and got[2]["n_assign"] == 0
    elif name == "op3":
        assert got[1]["n_email"] == 1
    elif name == "op4":
        assert got[1]["n_repeated_words"] > 100_000 and 2 not in got
    elif name == "op6":
        assert got[1]["component_id"] == got[3]["component_id"] == 1
    elif name == "op7":
        assert got[1]["n_words"] > 160_000 and got[2]["base_failed"]
    elif name == "op8":
        assert got[1]["n_hit"] == 9 and got[1]["n_items"] == 1
    elif name == "op9":
        assert got[1]["best_license"] == "MIT-notice"
    else:
        assert 0 <= got[1]["score"] <= 1
