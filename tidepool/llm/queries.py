"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import alignment, bottomk, bpe, cotraining, decontaminate, jaccard_join, license_scan, oracles, phrase_dedup, pii, quality_rules, spelling, suffix_dedup, url_filter
from tidepool.llm.session_tools import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op11_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.judge(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan, "op7_url_filter": op7_url_filter,
           "op8_phrase_dedup": op8_phrase_dedup, "op9_suffix_dedup": op9_suffix_dedup, "op10_pii": op10_pii, "op6_cotraining": op6_cotraining,
           "op2_bpe": op2_bpe, "op3_quality_rules": op3_quality_rules, "op4_jaccard_join": op4_jaccard_join, "op5_decontaminate": op5_decontaminate,
           "op11_bottomk": op11_bottomk, "op12_spelling": op12_spelling, "op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {"op1_license_scan": license_scan.oracle(), "op7_url_filter": url_filter.oracle(), **oracles.ORACLES}
