"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame; all
but the last have the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import mixing, near_dup, quality_rules, secret_scan, sentence_pieces
from orrery.llm.common import discard, n_stored, stored, table

MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score below 0.7) go; labels of the held-out fold aren't learned from."""
    model = quality_rules.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_rules.keep(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return near_dup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, copied ones too; documents stay. Values of more texts or sources are examples."""
    return secret_scan.redact(docs, mask_copied=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their source's target asks."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return sentence_pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: Trained rules, near-duplicate components and merges of token pieces have no SQL; the stages are tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. What a stage wrote for itself, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), n_stored(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
