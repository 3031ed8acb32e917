"""A corpus-cleaning pipeline: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusward.functions.lineage import stored
from corpusward.llm import neardup, packing, quality, substrings
from corpusward.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule, or a soft rule on a bad host, go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, 0.8) stays."""
    return neardup.keep_first(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go from the texts."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, cut into pieces and placed in sequences of 2048."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packed)]

#: SQL has no tokenizer; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
