"""The registered queries of the operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm import (
    decontaminate,
    divergence,
    hard_negatives,
    host_rules,
    html_extract,
    langid,
    line_crf,
    mixing,
    simhash,
    suffix_dedup,
    token_count,
    toxicity,
    vantage,
)
from orefold.llm.sql import DECONTAMINATION, DIVERGENCE, HARD_NEGATIVES, HOST_RULES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact repeats of 100 bytes leave of every document."""
    return suffix_dedup.removals(_table(spark, sf_dir, "documents"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in the mixture, with its place in the order."""
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its lines."""
    return line_crf.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics of every document and the verdict of its host; the source is the host."""
    return host_rules.judge(_table(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words lie from those of its language's other sources."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth vector; every seventh has another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every hundredth vector."""
    return vantage.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": html_extraction,
    "op2_suffix_array_dedup": suffix_array_dedup,
    "op3_mix_sources": mix_sources,
    "op4_simhash_near_dedup": simhash_near_dedup,
    "op5_quality_classifier": quality_classifier,
    "op6_quality_rules": quality_rules,
    "op7_benchmark_decontamination": benchmark_decontamination,
    "op8_toxicity": toxic_documents,
    "op9_language_id": language_id,
    "op10_token_counts": token_counts,
    "op11_source_divergence": source_divergence,
    "op12_hard_negatives": hard_negative_mining,
    "op13_nearest_neighbours": nearest_neighbours,
}
ORACLE = {
    "op6_quality_rules": HOST_RULES,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op11_source_divergence": DIVERGENCE,
    "op12_hard_negatives": HARD_NEGATIVES,
}
