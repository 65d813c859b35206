"""Queries of the subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm import ann, chat, langid, licenses, linededup, mixing, packing, simhash, tput, urlfilter
from millrace.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(load(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).drop("row")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_all(spark, load(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(load(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_groups(load(spark, sf_dir, "documents"))


def op9_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.search(load(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ann": op1_ann,
        "op2_langid": op2_langid,
        "op3_mixing": op3_mixing,
        "op4_chat": op4_chat,
        "op5_packing": op5_packing,
        "op6_urlfilter": op6_urlfilter,
        "op7_licenses": op7_licenses,
        "op8_linededup": op8_linededup,
        "op9_tput": op9_tput,
        "op10_simhash": op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.SQL,
        "op6_urlfilter": urlfilter.SQL,
        "op9_tput": tput.SQL,
    }
