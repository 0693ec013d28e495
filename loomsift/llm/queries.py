"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomsift.llm.bpe import bpe_encode
from loomsift.llm.exact_dedup import EXACT_SQL, LIVE_SQL, exact_duplicates
from loomsift.llm.html_extract import extract_pages
from loomsift.llm.licenses import license_scan
from loomsift.llm.mixing import mix_sources
from loomsift.llm.near_dedup import near_duplicates
from loomsift.llm.quality import CLEAN_LINES_SQL, clean_lines
from loomsift.llm.suffix_dedup import repeated_passages
from loomsift.llm.token_count import token_counts
from loomsift.llm.toxicity import toxic_documents


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def exact_dedup_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with deletions: documents that are labelled as bad are no longer live."""
    return exact_duplicates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 0"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_html": op6_html,
    "op7_near_dedup": op7_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "exact_dedup_live": exact_dedup_live,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality": CLEAN_LINES_SQL.replace("{documents}", "documents"),
    "op8_exact_dedup": EXACT_SQL.replace("{documents}", "documents"),
    "exact_dedup_live": LIVE_SQL.replace("{documents}", "documents").replace("{labels}", "labels"),
}
