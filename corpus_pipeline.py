"""Corpus pipeline: language ID, line dedup, near-duplicates, mixing, packing.

Each stage works on all rows that its predecessor kept, which are written as Parquet and
reread. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, linededup, mixing, packing, simhash
from millrace.llm.common import load
from millrace.scratch import delete, new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or of no clear language, go."""
    model = langid.train(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    return langid.recognised(spark, docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike across the corpus the first stays; documents left without a line go."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id."""
    return simhash.first_of_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut short or left out."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the language model nor the tokeniser; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; the last one's rows lie in the shared folder, the others' are deleted."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = new_folder(spark, f"corpus-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(written)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(written), written
    return docs
