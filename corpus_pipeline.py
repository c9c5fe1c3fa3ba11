"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage works on all that its predecessor kept. The classifiers learn from the labelled documents of the folder
that are not held out; what they judge is the whole text of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchwell.llm import language_id, nearcopies, packing, quality, queries
from patchwell.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, queries.quality_model(spark, sf_dir))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters, or likelier in no language, go."""
    return language_id.accepted(docs, queries.language_model(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that ball hashing brings together and a five-word Jaccard similarity of 0.8 or more links."""
    return nearcopies.deduplicated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document, cut and placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, queries.public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality classifier", quality_classifier), ("language ID", language_identification),
          ("SimHash near-dedup", near_copies), ("best-fit packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage{n}")
    return docs
