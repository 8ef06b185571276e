"""The corpus pipeline: rejects poor documents, keeps one of each group of near copies, drops benchmark text,
replaces personal data, and encodes what is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents;
the last returns doc_id, n_tokens, ids_sha256, decoded_sha256. Rows that repeat a doc_id or have none are kept or
dropped each by its own verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from tidepool.llm.session_tools import stage, table


#: Near copies agree in 80% of their five-word shingles; the query op4_jaccard_join has values of its own.
NEAR_SHINGLE = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs, percent=NEAR_PERCENT, shingle=NEAR_SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; those without words stay, and an item without words matches nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data, row by row; a null or empty text stays as it is."""
    return pii.replace(docs, pii.session_key(spark))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' tokens, row by row; a null or empty text has none."""
    return bpe.digests(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("pii", private), ("bpe", encoded)]
#: BPE and keyed surrogates have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
