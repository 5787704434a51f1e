"""Corpus pipeline: quality, exact copies, near copies, mixing, encoding.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Defined cases, for all stages: nulls in any column pass through where a row stays; an empty table gives an empty table; equal
rows count as documents of their own; columns beyond those of documents pass through under their names, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup, mixing, near_dedup, quality
from fieldloom.llm.bpe import n_tokens
from fieldloom.llm.common import table, written
from fieldloom.llm.queries import multilingual_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: those of a score of 0.5 at least; null and empty texts have the score of the bias."""
    return quality.without_bad(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest, then the smallest doc_id, nulls last, then the first row."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8. Texts without words all stay."""
    return near_dedup.without_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; a null source is a source, and texts without words go with the time at which they stand."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding gives the text back; an empty or null text has no ids."""
    codec = multilingual_tokenizer(spark)
    done = docs.select("doc_id", "lang", "source", "text", codec.round_trip(F.col("text")).alias("done"))
    done = done.select("doc_id", "lang", "source", "text", "done.ids", "done.decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "ids", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("source mixing", source_mixing),
    ("byte-level bpe", bpe_encoding),
]

#: The first stage learns a classifier and the third verifies similarities: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
