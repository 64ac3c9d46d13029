"""Cleaning pipeline over `documents`: quality, lines, near duplicates, substrings, packing.

Every stage takes all rows its predecessor kept; all but the last return the columns of documents. In every stage, columns other than doc_id, text and n_chars pass
unchanged, whatever their names; texts of any length are worked on whole; an empty table gives an empty result. For the rest:

* quality: a null text is judged as the empty one; a row with a null doc_id is judged, never fitted on; repeated rows are judged alike.
* lines: a null text stays null; a document whose lines all go stays, with an empty text; repeated rows count once and are all cleaned.
* near duplicates: of equal rows one stays; rows without words (null, empty, blank) all stay; a null doc_id goes after all others of its group.
* substrings: a null text stays null; repeated rows are repeats of each other; a document whose words all go stays, with an empty text.
* packing: a null text is the piece [0]; rows with a null doc_id, and repeated ones, are packed each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, near_dedup, packing, quality, substring
from tessera.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the threshold at least; the classifier is fitted on labelled rows of `docs`."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return line_dedup.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words in windows that repeat."""
    return substring.clean(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: The classifier, sketches and tokenizer have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, table(spark, sf_dir, "documents"))
