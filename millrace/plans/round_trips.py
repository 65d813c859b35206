"""Queries that write to a source or sink and read back, and the forms that the click-stream plans rewrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as X
from millrace.operators import filter_rows, global_aggregate, group_aggregate, materialized_scan, project, top_k
from millrace.plans.hits import hits
from millrace.schema import format_schema, parse_schema
from millrace.scratch import new_folder
from millrace.sources import colm, csv_to_parquet, read_csv, write_csv
from millrace.streaming import ingest_csv
from millrace.tables import load

c = F.col
SCHEMA = "k,int64\nn,int16\nc,int32\ns,string\nd,DATE\nt,TIMESTAMP\n"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the types of the schema text, with commas and quotes in the text."""
    text = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"'))
    return load(spark, d, "orders").select(
        c("o_orderkey").alias("k"), (c("o_custkey") % 100).cast("smallint").alias("n"), c("o_custkey").cast("int").alias("c"),
        text.alias("s"), c("o_orderdate").cast("date").alias("d"), c("o_orderdate").cast("timestamp_ntz").alias("t"),
    )


def _as_text(spark: SparkSession, d: str) -> str:
    """A folder of CSV text: every third row has its key only, and every third a field too many."""
    quoted = F.concat(F.lit('"'), F.replace("s", F.lit('"'), F.lit('""')), F.lit('"'))
    full = F.concat_ws(",", "k", "n", "c", quoted, "d", X.timestamp_text("t"))
    line = F.when(c("k") % 3 == 0, c("k").cast("string")).when(c("k") % 3 == 1, F.concat(full, F.lit(",more"))).otherwise(full)
    path = new_folder(spark, "csv")
    _typed(spark, d).select(line).write.text(path)
    return path


def _csv_read(spark: SparkSession, d: str) -> DataFrame:
    return read_csv(spark, _as_text(spark, d), parse_schema(SCHEMA), multi_line=False)


def _csv_write(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "csv")
    write_csv(_typed(spark, d), path)
    return spark.read.schema(parse_schema(SCHEMA)).csv(path, header=True, quote='"', escape='"')


def _csv_convert(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "converted")
    csv_to_parquet(spark, _as_text(spark, d), parse_schema(SCHEMA), path)
    return spark.read.parquet(path)


def _csv_stream(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "ingested")
    ingest_csv(spark, _as_text(spark, d), parse_schema(SCHEMA), path, new_folder(spark, "progress"), multi_line=False).awaitTermination()
    return spark.read.parquet(path)


def _result_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "result")
    write_csv(group_aggregate(load(spark, d, "orders"), ["o_orderpriority"], c=F.count(F.lit(1))), path, single_file=True)
    return spark.read.schema("o_orderpriority string, c bigint").csv(path, header=True, quote='"', escape='"')


def _colm(spark: SparkSession, d: str) -> DataFrame:
    colm.register(spark)
    path = new_folder(spark, "colm")
    _typed(spark, d).write.format("colm").mode("append").save(path)
    return spark.read.format("colm").load(path)


def _schema_text(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_schema(format_schema(parse_schema(SCHEMA))).fields
    return materialized_scan(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "i int, name string, kind string")


def _days(spark: SparkSession, d: str) -> DataFrame:
    day = c("o_orderdate").cast("date")
    return project(load(spark, d, "orders"), o_orderkey="o_orderkey", days=X.date_to_days(day).cast("bigint"), back=X.days_to_date(X.date_to_days(day)))


def _q36(spark: SparkSession, d: str) -> DataFrame:
    keys = [c("ClientIP"), *[(c("ClientIP").cast("bigint") - i).alias(f"m{i}") for i in (1, 2, 3)]]
    return top_k(group_aggregate(hits(spark, d), keys, c=F.count(F.lit(1))), [("c", False), "ClientIP"], 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op_csv_read": _csv_read,
    "op_csv_write": _csv_write,
    "op_csv_convert": _csv_convert,
    "op_csv_stream": _csv_stream,
    "op_result_sink": _result_sink,
    "op_colm_round_trip": _colm,
    "op_schema_text": _schema_text,
    "op_timestamp_text": lambda s, d: project(load(s, d, "events"), event_id="event_id", at=X.timestamp_text("ts")),
    "op_date_days": _days,
    "op_like_contains": lambda s, d: filter_rows(load(s, d, "pages"), X.like_contains("url", "%example.org%")).select("page_id"),
    "op_q30_plain": lambda s, d: global_aggregate(hits(s, d), **{f"s{i}": F.sum(c("ResolutionWidth") + i) for i in range(90)}),
    "op_q36_plain": _q36,
}

_TYPED = """SELECT o_orderkey AS k, CAST(o_custkey % 100 AS SMALLINT) AS n, CAST(o_custkey AS INTEGER) AS c,
  o_orderpriority || ', "' || o_orderstatus || '"' AS s, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t FROM orders"""
_READ = f"""SELECT k, CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS n, CASE WHEN k % 3 = 0 THEN 0 ELSE c END AS c, CASE WHEN k % 3 = 0 THEN '' ELSE s END AS s,
  CASE WHEN k % 3 = 0 THEN DATE '1970-01-01' ELSE d END AS d, CASE WHEN k % 3 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE t END AS t FROM ({_TYPED})"""

#: DuckDB SQL; what is written and read back must be what was there.
ORACLE = {
    "op_csv_read": _READ,
    "op_csv_write": _TYPED,
    "op_csv_convert": _READ,
    "op_csv_stream": _READ,
    "op_result_sink": "SELECT o_orderpriority, COUNT(*) AS c FROM orders GROUP BY o_orderpriority",
    "op_colm_round_trip": _TYPED,
    "op_schema_text": "SELECT i, name, kind FROM (VALUES (0, 'k', 'bigint'), (1, 'n', 'smallint'), (2, 'c', 'int'), (3, 's', 'string'), (4, 'd', 'date'), (5, 't', 'timestamp_ntz')) AS t(i, name, kind)",
    "op_timestamp_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "op_date_days": "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(o_orderdate AS DATE) AS back FROM orders",
    "op_like_contains": "SELECT page_id FROM pages WHERE contains(url, 'example.org')",
}
