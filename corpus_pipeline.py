"""The corpus pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldframe.llm.common import shared_dir, stable, table
from foldframe.llm.decontaminate import decontaminated
from foldframe.llm.quality import kept as good
from foldframe.llm.sentencepieces import encode
from foldframe.llm.simhash import near_duplicates
from foldframe.llm.toxicity import accepted

SENTENCEPIECE_MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id, once. Rows without an id can't be told apart and stay."""
    kept = near_duplicates(docs).select("component_id").distinct().withColumnRenamed("component_id", "doc_id")
    own = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return own.unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and where each starts in the original bytes. Of the documents' own columns only doc_id goes on."""
    return encode(docs, public_tokenizers.path(SENTENCEPIECE_MODEL))


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Trained models and XXH64 fingerprints have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage gives is kept in the shared folder, so that it's worked out once."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stable(docs)
    return docs
