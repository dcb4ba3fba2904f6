"""A corpus pipeline: quality rules, line dedup, one document of each group of near copies, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each stage's frame to the shared folder and reads
it back as the next one's docs. All stages but the last return the columns of documents, and of others that docs may have, whatever
their names.

Results for edge cases, by stage. Null and empty texts: rejected by quality rules; kept by the later stages, had they been kept, and
packed as their end token alone. Very long texts are read whole by all. Null ids: kept as null; a row without an id gives way to its
near copies with one, and counts as smaller than all ids where the first copy of a line is sought. Repeated rows: line dedup folds them,
near copies leave one. Empty tables give empty results. Ties: the smallest id, then the smallest hash of the text, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontamination, jaccard_join, line_dedup, packing, quality_rules
from corvane.llm.common import Scratch
from corvane.llm.queries import WORD_BPE


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rules or lose too much."""
    return quality_rules.clean_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that are nothing else."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.drop_near_copies(docs, by_row=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.best_fit_packing(docs, packing.public_tokenizer(WORD_BPE))


STAGES = [("quality_rules", clean), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]
#: String tiling and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = scratch.keep(stage(spark, docs, sf_dir), name), docs
        scratch.drop(before)
    return docs
