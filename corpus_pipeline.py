"""From raw documents to packed training sequences: filter, deduplicate, decontaminate, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns that came in.  Defined results: an empty table passes
through; rows without id are never dropped as duplicates of others; a row that
repeats another's id and text is one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, table
from orrery.llm.decontamination import find_leaks
from orrery.llm.jaccard_join import JaccardJoin
from orrery.llm.packing import pack_documents
from orrery.llm.pii import scan_personal
from orrery.llm.quality_rules import judge_quality


def _with_row(docs: DataFrame) -> DataFrame:
    """Id and text, and the whole row as one column, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = judge_quality(_with_row(docs), table(spark, sf_dir, "labels"), carry=["_row"])
    return judged.where("kept").select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id."""
    grouped = JaccardJoin(docs).grouped()
    gone = grouped.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    named = kept.where("doc_id is not null").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return named.drop("_h").union(kept.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: what leaks one item's passage is not trained on."""
    found = find_leaks(_with_row(docs), table(spark, sf_dir, "benchmark"), carry=["_row"])
    return found.where(F.size("runs") == 0).select("_row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, and ``n_chars`` counted anew."""
    found = scan_personal(_with_row(docs), id_col="_row", redact=True)
    clean = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("bigint"), F.col("_row.n_chars"))}
    return found.select(*(clean.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and its place there."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: Similarity components, the field and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
