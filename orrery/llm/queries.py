"""The registered queries of this subpackage: each applies one operator to its whole table; those without a number check a part by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import base_queries
from orrery.llm.common import table
from orrery.llm.decontamination import op8_decontamination, op8_sql
from orrery.llm.jaccard_join import op6_ngram_jaccard_join, op6_sql
from orrery.llm.license_scan import op9_license_scan, op9_sql
from orrery.llm.packing import op1_best_fit_packing
from orrery.llm.pii import op3_pii
from orrery.llm.quality_rules import op7_quality_rules
from orrery.llm.secret_scan import op2_secret_scan
from orrery.llm.substring_dedup import op4_substring_dedup
from orrery.llm.toxicity import op10_toxicity
from orrery.llm.url_filter import op5_url_filter


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_best_fit_packing(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_substring_dedup(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_url_filter(table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_license_scan(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1,
        "op2_secret_scan": op2,
        "op3_pii": op3,
        "op4_substring_dedup": op4,
        "op5_url_filter": op5,
        "op6_ngram_jaccard_join": op6,
        "op7_quality_rules": op7,
        "op8_decontamination": op8,
        "op9_license_scan": op9,
        "op10_toxicity": op10,
        **base_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return base_queries.oracle_sql() | {"op6_ngram_jaccard_join": op6_sql(), "op8_decontamination": op8_sql(), "op9_license_scan": op9_sql()}
