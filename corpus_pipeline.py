"""The corpus pipeline: documents through quality rules, quality classifier, near-duplicate join, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import line_crf, mixing, near_pairs, packing, quality_rules
from threadloom.llm.common import remove, scratch, table, temporary, write_table

LEAST_SCORE = 0.5


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the distribution rules keep."""
    return quality_rules.keep_good(docs)


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good; it is fitted on labelled documents of the whole table, since few
    of the bad ones are left after the rules."""
    model = line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_crf.keep(docs, model, LEAST_SCORE)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each class of documents that are connected by similarity."""
    return near_pairs.one_of_each(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time that it takes any of a document's words.

    A document that the mix does not take is left out, one that it takes more than once is repeated."""
    return mixing.repeated(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality_rules),
    ("quality_classifier", stage_quality_classifier),
    ("near_duplicates", stage_near_duplicates),
    ("source_mixing", stage_mixing),
    ("best_fit_packing", stage_packing),
]
#: The classifier's forward-backward sweeps and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet to the shared folder and read by the next.

    A stage's own scratch tables go once it is written, and its input with them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with temporary(spark):
            docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
