"""The corpus pipeline: toxic documents go, near copies and repeated passages too, then sources are mixed and packed.

Each stage is a call of one operator of ``trigrove.llm``; its result is written as Parquet and read again as the next
stage's documents. ``run`` does that in the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trigrove.llm import jaccard, mixing, packing, suffixes, toxicity
from trigrove.llm.common import delete, read, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the lexicon scores 0.5 or more; null and empty texts stay, and repeated rows do as one does."""
    return toxicity.stage(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones, and one of repeated rows; those without an id or words stay."""
    return jaccard.stage(spark, docs, sf_dir)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that occur earlier; what has nothing left goes, what was empty stays."""
    return suffixes.stage(spark, docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source (null is one) to its target, repeating documents, in the order of the curriculum; empty texts go."""
    return mixing.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents into sequences, each row for itself."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [("toxicity", toxic), ("jaccard_join", near_copies), ("suffix_dedup", repeats), ("mixing", mixed), ("packing", packed)]

#: Lexicons are learned and fingerprints aren't SQL's: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table ``documents`` and gives the last one's rows; an empty table gives none.

    A stage's table goes when the next one is written.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            delete(before)
        before = docs
    return docs
