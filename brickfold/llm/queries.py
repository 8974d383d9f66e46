"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, mixing, quality, secrets, simhash, spelling, substrings, suffixes, token_counts, toxicity, vector_codes
from .common import documents


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(documents(spark, folder))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_report(documents(spark, folder))


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.suffix_report(documents(spark, folder))


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_report(chat.with_marked(spark, spark.read.parquet(f"{folder}/conversations.parquet")))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


QUERIES = {"op9_suffixes": op9_suffixes, "op1_simhash": op1_simhash, "op2_substrings": op2_substrings, "op3_mixing": op3_mixing, "op8_quality_rules": op8_quality_rules, "op4_byte_bpe": op4_byte_bpe, "op5_secrets": op5_secrets, "op7_toxicity": op7_toxicity, "op6_token_counts": op6_token_counts, "op10_exact_dedup": op10_exact_dedup, "op11_chat_format": op11_chat_format, "op12_vector_codes": op12_vector_codes, "op13_spelling_variants": op13_spelling_variants}

SQL = {"op10_exact_dedup": exact.SQL, "op11_chat_format": chat.SQL, "op12_vector_codes": vector_codes.SQL}
