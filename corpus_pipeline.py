"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemill.llm import decontaminate, near_dedup, pieces, quality, surrogates
from wavemill.llm.common import staged, surrogate_key, table


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the rated ones, rejects."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return _as_documents(near_dedup.kept_documents(docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return _as_documents(decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text; n_chars follows."""
    return _as_documents(surrogates.replaced(docs, surrogate_key(spark)), docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left into ids, and decodes them again as a check."""
    return pieces.encode(docs, pieces.default_model(), keep=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", pii_stage),
    ("SentencePiece", pieces_stage),
]

#: No SQL gives a trained classifier, surrogates or Viterbi pieces; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs) if k < len(STAGES) - 1 else docs
    return docs
