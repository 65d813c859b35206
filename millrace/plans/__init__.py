"""Query plans and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import clickstream, native, oracle, round_trips
from millrace.plans.hits import hits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: (lambda s, d, k=k: clickstream.run(k, hits(s, d), clickstream.SCALED)) for k in clickstream.PLANS}
    return named | native.QUERIES | round_trips.QUERIES


def oracle_sql() -> dict[str, str]:
    clicks = oracle.oracle()
    return clicks | round_trips.ORACLE | {"op_q30_plain": clicks["q30"], "op_q36_plain": clicks["q36"]}
