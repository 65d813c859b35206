import datetime
from math import trunc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import functions as X
from millrace.operators import global_aggregate, limit_rows, materialized_scan, offset_rows, sort_rows, top_k


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,n", [("é", 2), ("", 0), ("日本", 6)])
def test_byte_length(spark, text, n):
    assert one(spark, X.byte_length("x"), x=text) == n


@settings(max_examples=15, deadline=None)
@given(st.integers(-(2**40), 2**40), st.integers(-5, 5))
def test_div_or_zero(spark, a, b):
    assert one(spark, X.div_or_zero("a", "b"), a=a, b=b) == (0 if b == 0 else int(abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=5))
def test_avg_trunc_is_exact(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    total = sum(xs)
    want = abs(total) // len(xs) * (1 if total >= 0 else -1)
    assert df.agg(X.avg_trunc("x")).first()[0] == want
    assert int(df.agg(X.sum_exact("x")).first()[0]) == total


@pytest.mark.parametrize("url,host", [("http://www.a.com/x", "a.com"), ("https://b.org", "b.org"), ("noscheme/x", ""), ("ftp://c.d/e", "c.d"), ("http:///x", "")])
def test_url_host(spark, url, host):
    assert one(spark, X.url_host("u"), u=url) == host


@pytest.mark.parametrize("pattern,text,hit", [("%a%", "bab", True), ("a", "bab", True), ("%a_c%", "abc", False), ("%a_c%", "xa_cx", True), ("%A%", "a", False)])
def test_like_contains(spark, pattern, text, hit):
    assert one(spark, X.like_contains("x", pattern), x=text) is hit


def test_like_is_sql_like(spark):
    assert one(spark, X.like("x", "a_c%"), x="abcd") is True and one(spark, X.like("x", "b"), x="abc") is False


def test_time_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:59.5' AS t, DATE'2024-01-02' AS d")
    row = df.select(X.extract_hour("t"), X.extract_minute("t"), X.trunc_minute("t").alias("m"), X.timestamp_text("t"), X.date_to_days("d"), X.days_to_date(X.date_to_days("d")))
    assert dict(row.dtypes)["m"] == "timestamp_ntz"
    assert list(row.first()) == [3, 4, datetime.datetime(2024, 1, 2, 3, 4), "2024-01-02 03:04:59", 19724, datetime.date(2024, 1, 2)]


def test_arithmetic_widens(spark):
    df = spark.sql("SELECT CAST(-2147483648 AS INT) AS a, CAST(2 AS SMALLINT) AS b")
    assert list(df.select(X.subtract("a", "b"), X.add("a", "a"), X.multiply("a", "b")).first()) == [-2147483650, -4294967296, -4294967296]


def test_empty_input(spark):
    none = spark.range(0).withColumn("t", F.lit("x"))
    row = global_aggregate(none, c=F.count(F.lit(1)), s=F.sum("id"), a=X.avg_trunc("id"), m=F.min("t"), u=F.count_distinct("id")).first()
    assert list(row) == [0, None, None, None, 0]


def test_order_limit_offset(spark):
    df = materialized_scan(spark, [("z", 1), ("Z", 2), ("é", 3), ("a", 4), ("a", 5)], "k string, n int")
    assert [r[0] for r in sort_rows(df, ["k", ("n", False)]).collect()] == ["Z", "a", "a", "z", "é"]
    assert [r[1] for r in top_k(df, ["k", ("n", False)], 2, 1).collect()] == [5, 4]
    past = offset_rows(df, 100)
    assert past.collect() == [] and past.columns == ["k", "n"]
    assert limit_rows(df, 2).count() == 2


def test_if_else_takes_literals(spark):
    assert one(spark, X.if_else(F.col("x") > 1, F.lit("a"), "b"), x=1) == "b" and trunc(1.5) == 1
