"""The corpus pipeline: quality, toxicity, near-dedup, decontamination, tokenising, in that order.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its predecessor
kept; every stage but the last returns the columns of ``documents``. A runner may write each
result as Parquet and hand the reread table to the next stage, as ``run`` does through the
shared checkpoint folder.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import bpe, decontaminate, quality, simhash, toxicity
from mnemospark.llm.common import cut_lineage, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the operator's threshold."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.drop_low_quality(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of alike texts (SimHash search over five-word shingles, Jaccard 0.8)."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=Fraction(4, 5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document left."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokenise", tokenise_stage),
]

#: The stages hold learned models and tokenisers; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are cut to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
