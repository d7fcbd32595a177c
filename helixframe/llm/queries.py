"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import exact_dedup, langid, longmatch, mixing, near_dedup, packing, quality, secrets, toxicity, warc

_QUALITY = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*_QUALITY)


def op6_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longmatch.long_match_digest(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_language_id, op3_warc, op4_secrets, op5_quality, op6_long_matches, op7_exact_dedup, op8_mixing, op9_packing, op10_toxicity)
}

#: The other operators are tested against brute force (tests/llm).
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op5_quality": quality.ORACLE,
    "op6_long_matches": longmatch.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_packing": packing.ORACLE,
}
