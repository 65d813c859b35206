"""Column helpers, only where plain Spark functions differ from the engine's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_length(x: Column | str) -> Column:
    """STRLEN: bytes of the UTF-8 text, as BIGINT."""
    return F.octet_length(_col(x)).cast("bigint")


def add(a: Column | str, b: Column | str) -> Column:
    return _col(a).cast("bigint") + _col(b).cast("bigint")


def subtract(a: Column | str, b: Column | str) -> Column:
    return _col(a).cast("bigint") - _col(b).cast("bigint")


def multiply(a: Column | str, b: Column | str) -> Column:
    return _col(a).cast("bigint") * _col(b).cast("bigint")


def div_or_zero(a: Column | str, b: Column | str) -> Column:
    """Integer division truncated toward zero; x / 0 is 0."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))


def sum_exact(x: Column | str) -> Column:
    """SUM in 128 bits: DECIMAL(38,0)."""
    return F.sum(_col(x).cast("decimal(38,0)"))


def avg_trunc(x: Column | str) -> Column:
    """AVG over a 128-bit sum, truncated toward zero to BIGINT; NULL over no rows."""
    x = _col(x)
    n = F.count(x).cast("decimal(20,0)")
    return F.call_function("div", F.sum(x.cast("decimal(38,0)")), F.nullif(n, F.lit(0).cast("decimal(20,0)")))


def like(x: Column | str, pattern: str) -> Column:
    return _col(x).like(pattern)


def like_contains(x: Column | str, pattern: str) -> Column:
    """Contains-only LIKE: one leading and one trailing ``%`` are dropped, the rest is literal."""
    return _col(x).contains(pattern.removeprefix("%").removesuffix("%"))


def extract_minute(ts: Column | str) -> Column:
    return F.minute(_col(ts)).cast("bigint")


def extract_hour(ts: Column | str) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def trunc_minute(ts: Column | str) -> Column:
    """DATE_TRUNC('minute'), kept zone-free."""
    return F.date_trunc("minute", _col(ts)).cast("timestamp_ntz")


def url_host(x: Column | str) -> Column:
    """Host after the first ``://`` without one ``www.``; '' if there is no ``://``."""
    return F.regexp_extract(_col(x), r"(?s)^.*?://(?:www\.)?([^/]*)", 1)


def if_else(condition: Column, a: Column | str, b: Column | str) -> Column:
    return F.when(condition, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))


def timestamp_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def date_to_days(d: Column | str) -> Column:
    return F.unix_date(_col(d))


def days_to_date(n: Column | str) -> Column:
    return F.date_from_unix_date(_col(n))
