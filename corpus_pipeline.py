"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, BPE encoding.

Each stage takes what its predecessor kept; its result is written as Parquet and read again. All but the last return the
columns of ``documents``. Columns beside those, whatever their names, are ignored by every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.llm.bpe import bpe_encode
from loomsift.llm.exact_dedup import drop_exact_duplicates
from loomsift.llm.mixing import mix_sources
from loomsift.llm.near_dedup import drop_near_duplicates
from loomsift.llm.quality import clean_lines
from loomsift.llm.store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the line rules, cleaned; the rejected go.

    Null, empty and blank texts are rejected; nulls elsewhere, ties and repeated rows pass; long texts are seen whole; an
    empty table gives none. ``n_chars`` is that of the cleaned text.
    """
    return clean_lines(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text.

    First is the least ``doc_id``, null being last; of rows of one id and text the one whose other columns come first.
    Null texts stay, an empty text is a text like others; an empty table gives none.
    """
    return drop_exact_duplicates(docs, *COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by ``doc_id``, of each group of near copies.

    Null ids and texts stay; texts without words are copies of their equals only; of repeated rows, which the stage before
    leaves none of, all stay or go; an empty table gives none.
    """
    return drop_near_duplicates(docs, *COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mixed blocks hold, each under its document's id; ``n_chars`` is the piece's.

    Null, empty and blank texts have no pieces; a null source is one of its own, the empty one; null ids and languages are
    kept; repeated rows count as often as they occur; a long text is as many pieces as it fills blocks; an empty table gives
    none.
    """
    return mix_sources(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each piece: one row for each row, whatever is repeated; null texts have null tokens, empty ones none."""
    return bpe_encode(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixed), ("bpe", encoded)]

#: Shingle similarity, permuted draws and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on a table of documents."""
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
