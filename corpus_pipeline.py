"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and decides with one operator of
``corvane.llm``; all but the last return the columns of ``documents``.

Defined results, of every stage: a null or empty text has no language and goes in the first stage; no other null matters to what stays (a null
``doc_id`` is a row of its own, a null source or language a site of its own). Rows that repeat are judged as rows of their own until near
duplicates, where one stays; ties go to the smaller ``doc_id``, then to the least text. Extra columns stay as they are whatever their names, and
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import langid, neardup, packing, quality
from corvane.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters, null ones and undecided ones go. Without anything to learn from all go."""
    return langid.keep_identified(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from ``labels``, and without labels of both classes judges by their base rate."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that of the smallest id. Rows without an id all stay."""
    return neardup.keep_first(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, filled with lexical neighbours. Every document's ids stand in pieces once."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("packing", packed),
]

#: No SQL: the language model, the classifier and the retrieval order can't be expressed. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, made = docs, len(Scratch.made)
        docs = scratch.keep(stage(spark, before, sf_dir), name)
        Scratch.clear_since(made)  # what the stage wrote meanwhile
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
