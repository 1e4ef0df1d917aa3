"""Documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage works on all rows its predecessor kept and is a function of (spark, docs, sf_dir); run() writes what a
stage returns as Parquet in the shared folder and hands it to the next one as docs.

A null or blank text fails the quality rules, so later stages see none but where they are called on their own. Rows that
repeat each other are judged each by the first two stages; near-dedup keeps one of a doc_id. Rows without a doc_id are
judged by the quality rules, stay whole in line dedup and near-dedup, and are mixed and packed like others. Texts of any
length are read whole; columns of any other name pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm import line_dedup, mixing, near_dup, packing, quality_rules
from postlode.llm._tables import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: similarity of 0.8 and more."""
    return near_dup.drop_near_duplicates(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("source mixing", mixed), ("best-fit packing", packed)]

#: No SQL: quality rules, near-dedup and packing can't be expressed. tests/llm compares the operators behind the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
