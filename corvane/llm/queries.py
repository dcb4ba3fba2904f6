"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import clustering, decontamination, jaccard_join, katz, line_dedup, packing, quality_classifier, quality_rules, secrets, token_counts, token_files, warc, whitening

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), packing.public_tokenizer(WORD_BPE))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "line_start", "line_end", "n_lines")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that are left after false positives are removed."""
    return secrets.secret_findings(table(spark, sf_dir, "documents")).filter("is_secret").drop("is_secret")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), packing.public_tokenizer(PIECES))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_katz_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), order=3)


def op11_yinyang_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.yinyang_clusters(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), packing.public_tokenizer(WORD_BPE))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return got.withColumn("deviation", got["deviation"].cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_best_fit_packing, op3_line_dedup, op4_warc_round_trip, op5_secret_scan, op6_quality_classifier, op7_ngram_jaccard_join, op8_token_counts, op9_quality_rules, op10_katz_lm_scoring, op11_yinyang_clustering, op12_token_files, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op4_warc_round_trip": warc.ORACLE_SQL, "op7_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL, "op11_yinyang_clustering": clustering.ORACLE_SQL}
