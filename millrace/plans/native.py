"""Queries that exercise single operators on the native tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as X
from millrace.operators import filter_rows, global_aggregate, group_aggregate, materialized_scan, project, sort_rows, table_scan, top_k
from millrace.tables import load

c = F.col


def n():
    return F.count(F.lit(1))


def _scan_project(spark: SparkSession, d: str) -> DataFrame:
    orders = table_scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    return project(filter_rows(orders, c("o_orderkey") < 500), k="o_orderkey", st="o_orderstatus", dt="o_orderdate")


def _comparisons(spark: SparkSession, d: str) -> DataFrame:
    kept = filter_rows(load(spark, d, "lineitem"), ((c("l_linenumber") < 3) & (c("l_quantity") > 45.0)) | ~(c("l_linenumber") <= 6))
    return kept.select("l_orderkey", "l_linenumber")


def _arith(spark: SparkSession, d: str) -> DataFrame:
    return project(load(spark, d, "events"), event_id="event_id", a=X.add("user_id", F.lit(7)), b=X.subtract("user_id", F.lit(7)), c=X.multiply("user_id", F.lit(1000003)))


def _div(spark: SparkSession, d: str) -> DataFrame:
    return project(load(spark, d, "events"), event_id="event_id", q=X.div_or_zero(c("event_id") - 5000, c("user_id") % 5))


def _global(spark: SparkSession, d: str) -> DataFrame:
    return global_aggregate(
        load(spark, d, "lineitem"), c=n(), s=F.sum("l_linenumber"), a=F.avg("l_linenumber"),
        mn=F.min("l_returnflag"), mx=F.max("l_shipdate"), u=F.count_distinct("l_suppkey"),
    )


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return group_aggregate(
        load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], c=n(), s=F.sum("l_linenumber"), a=F.avg("l_linenumber"),
        mn=F.min("l_shipdate"), mx=F.max("l_partkey"), u=F.count_distinct("l_suppkey"),
    )


def _case(spark: SparkSession, d: str) -> DataFrame:
    k = X.if_else((c("o_orderstatus") == "F") & (c("o_orderkey") % 2 == 0), c("o_orderpriority"), "")
    return group_aggregate(load(spark, d, "orders"), [k.alias("k")], c=n())


def _empty(spark: SparkSession, d: str) -> DataFrame:
    none = filter_rows(load(spark, d, "events"), c("event_id") < 0)
    return global_aggregate(none, c=n(), s=F.sum("user_id"), a=F.avg("user_id"), mn=F.min("event_type"), u=F.count_distinct("user_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op_scan_project": _scan_project,
    "op_filter_lt_gt_and_or_not": _comparisons,
    "op_arith": _arith,
    "op_div_or_zero": _div,
    "op_extract_hour": lambda s, d: group_aggregate(load(s, d, "events"), [X.extract_hour("ts").alias("h")], c=n()),
    "op_trunc_minute": lambda s, d: project(load(s, d, "events"), event_id="event_id", m=X.trunc_minute("ts")),
    "op_byte_length": lambda s, d: project(load(s, d, "documents"), doc_id="doc_id", n=X.byte_length("text")),
    "op_url_host": lambda s, d: project(load(s, d, "pages"), page_id="page_id", host=X.url_host("url")),
    "op_regexp_replace": lambda s, d: project(load(s, d, "pages"), page_id="page_id", host=F.regexp_replace("url", r"^https?://(?:www\.)?([^/]+)/.*$", "$1")),
    "op_like": lambda s, d: filter_rows(load(s, d, "pages"), X.like("url", "%example.org%") & ~X.like("url", "%www.%")).select("page_id", "url"),
    "op_case_group_key": _case,
    "op_in_list": lambda s, d: filter_rows(load(s, d, "part"), c("p_size").isin(-1, 6, 7)).select("p_partkey"),
    "op_global_agg": _global,
    "op_group_agg": _grouped,
    "op_avg_trunc": lambda s, d: group_aggregate(load(s, d, "lineitem"), ["l_returnflag"], a=X.avg_trunc("l_partkey")),
    "op_having": lambda s, d: filter_rows(group_aggregate(load(s, d, "orders"), ["o_custkey"], c=n()), c("c") > 12),
    "op_topk_mixed": lambda s, d: top_k(group_aggregate(load(s, d, "part"), ["p_brand", "p_type"], c=n()), [("c", False), "p_brand", ("p_type", False)], 10),
    "op_sort_full": lambda s, d: sort_rows(load(s, d, "customer").select("c_mktsegment", "c_custkey"), [("c_mktsegment", False), "c_custkey"]),
    "op_offset_limit": lambda s, d: top_k(load(s, d, "orders"), [("o_totalprice", False), "o_orderkey"], 10, 1000).select("o_orderkey"),
    "op_values_scan": lambda s, d: materialized_scan(s, [(1, "a"), (2, ""), (3, "é")], "k int, v string"),
    "op_empty_input": _empty,
}
