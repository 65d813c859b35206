"""The 43 click-stream queries as DataFrame plans.

Each plan takes the ``hits`` DataFrame and keyword parameters: date range, HAVING
threshold and offset. The defaults are the ones of the query set; ``SCALED`` holds the
values that keep the derived test table's answers non-empty. Every LIMIT has a total
order, so ties cannot change a result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import byte_length, extract_minute, if_else, subtract, trunc_minute
from millrace.operators import filter_rows, global_aggregate, group_aggregate, project, sort_rows, top_k

HOST_PATTERN = r"^https?://(?:www\.)?([^/]+)/.*$"


@dataclass(frozen=True)
class Params:
    month: tuple[str, str] = ("2013-07-01", "2013-07-31")
    days: tuple[str, str] = ("2013-07-14", "2013-07-15")
    having: int = 100_000
    user: int = 435090932899640449
    offset: int = 1000
    offset_hash: int = 100
    offset_window: int = 10_000


SCALED = Params(("2024-01-01", "2024-01-31"), ("2024-01-14", "2024-01-15"), 100, 13, 100, 10, 100)

c = F.col


def n() -> Column:
    return F.count(F.lit(1))


def month(p: Params, *more: Column, days: bool = False) -> Column:
    lo, hi = p.days if days else p.month
    out = (c("CounterID") == 62) & c("EventDate").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    for m in more:
        out = out & m
    return out


def top(df: DataFrame, keys: list[str], by: str, *, limit: int = 10, offset: int = 0) -> DataFrame:
    """Largest ``by`` first, ties by the keys."""
    return top_k(df, [(by, False), *keys], limit, offset)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return top(group_aggregate(df, list(keys), c=n()), list(keys), "c")


def distinct_users(df: DataFrame, *keys: str) -> DataFrame:
    return top(group_aggregate(df, list(keys), u=F.count_distinct("UserID")), list(keys), "u")


def views(df: DataFrame, keys: list[str], offset: int = 0) -> DataFrame:
    return top(group_aggregate(df, keys, PageViews=n()), keys, "PageViews", offset=offset)


def refreshes(df: DataFrame, *keys: str) -> DataFrame:
    return top(group_aggregate(df, list(keys), c=n(), s=F.sum("IsRefresh"), a=F.avg("ResolutionWidth")), list(keys), "c")


def phrase() -> Column:
    return c("SearchPhrase") != ""


def model() -> Column:
    return c("MobilePhoneModel") != ""


def q30(h: DataFrame, p: Params) -> DataFrame:
    """SUM(x + i) is SUM(x) + i * COUNT(x): two aggregates instead of ninety."""
    both = global_aggregate(h, s=F.sum("ResolutionWidth"), k=F.count("ResolutionWidth"))
    return project(both, **{f"s{i}": c("s") + F.lit(i).cast("bigint") * c("k") for i in range(90)})


def q36(h: DataFrame, p: Params) -> DataFrame:
    """The other keys depend on ClientIP, so one key is grouped and the rest projected."""
    best = counted(h, "ClientIP")
    return project(best, ClientIP="ClientIP", **{f"m{i}": subtract("ClientIP", F.lit(i)) for i in (1, 2, 3)}, c="c")


def q40(h: DataFrame, p: Params) -> DataFrame:
    kept = filter_rows(h, month(p, c("IsRefresh") == 0))
    src = if_else((c("SearchEngineID") == 0) & (c("AdvEngineID") == 0), c("Referer"), "")
    keys = ["TraficSourceID", "SearchEngineID", "AdvEngineID", "Src", "Dst"]
    return views(kept.select(*keys[:3], src.alias("Src"), c("URL").alias("Dst")), keys, p.offset)


def q43(h: DataFrame, p: Params) -> DataFrame:
    kept = filter_rows(h, month(p, c("IsRefresh") == 0, c("DontCountHits") == 0, days=True))
    return top_k(group_aggregate(project(kept, M=trunc_minute("EventTime")), ["M"], PageViews=n()), ["M"], 10, p.offset)


PLANS: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    "q01": lambda h, p: global_aggregate(h, c=n()),
    "q02": lambda h, p: global_aggregate(filter_rows(h, c("AdvEngineID") != 0), c=n()),
    "q03": lambda h, p: global_aggregate(h, s=F.sum("AdvEngineID"), c=n(), a=F.avg("ResolutionWidth")),
    "q04": lambda h, p: global_aggregate(h, a=F.avg("UserID")),
    "q05": lambda h, p: global_aggregate(h, u=F.count_distinct("UserID")),
    "q06": lambda h, p: global_aggregate(h, u=F.count_distinct("SearchPhrase")),
    "q07": lambda h, p: global_aggregate(h, mn=F.min("EventDate"), mx=F.max("EventDate")),
    "q08": lambda h, p: sort_rows(group_aggregate(filter_rows(h, c("AdvEngineID") != 0), ["AdvEngineID"], c=n()), [("c", False), "AdvEngineID"]),
    "q09": lambda h, p: distinct_users(h, "RegionID"),
    "q10": lambda h, p: top(group_aggregate(h, ["RegionID"], s=F.sum("AdvEngineID"), c=n(), a=F.avg("ResolutionWidth"), u=F.count_distinct("UserID")), ["RegionID"], "c"),
    "q11": lambda h, p: distinct_users(filter_rows(h, model()), "MobilePhoneModel"),
    "q12": lambda h, p: distinct_users(filter_rows(h, model()), "MobilePhone", "MobilePhoneModel"),
    "q13": lambda h, p: counted(filter_rows(h, phrase()), "SearchPhrase"),
    "q14": lambda h, p: distinct_users(filter_rows(h, phrase()), "SearchPhrase"),
    "q15": lambda h, p: counted(filter_rows(h, phrase()), "SearchEngineID", "SearchPhrase"),
    "q16": lambda h, p: counted(h, "UserID"),
    "q17": lambda h, p: counted(h, "UserID", "SearchPhrase"),
    "q18": lambda h, p: top_k(group_aggregate(h, ["UserID", "SearchPhrase"], c=n()), ["UserID", "SearchPhrase"], 10),
    "q19": lambda h, p: counted(h.select("UserID", extract_minute("EventTime").alias("m"), "SearchPhrase"), "UserID", "m", "SearchPhrase"),
    "q20": lambda h, p: filter_rows(h, c("UserID") == p.user).select("UserID"),
    "q21": lambda h, p: global_aggregate(filter_rows(h, c("URL").like("%google%")), c=n()),
    "q22": lambda h, p: top(group_aggregate(filter_rows(h, c("URL").like("%google%") & phrase()), ["SearchPhrase"], mu=F.min("URL"), c=n()), ["SearchPhrase"], "c"),
    "q23": lambda h, p: top(
        group_aggregate(
            filter_rows(h, c("Title").like("%Google%") & ~c("URL").like("%.google.%") & phrase()), ["SearchPhrase"],
            mu=F.min("URL"), mt=F.min("Title"), c=n(), u=F.count_distinct("UserID"),
        ), ["SearchPhrase"], "c"),
    "q24": lambda h, p: top_k(filter_rows(h, c("URL").like("%google%")), ["EventTime", "WatchID"], 10),
    "q25": lambda h, p: top_k(filter_rows(h, phrase()), ["EventTime", "SearchPhrase"], 10).select("SearchPhrase"),
    "q26": lambda h, p: top_k(filter_rows(h, phrase()).select("SearchPhrase"), ["SearchPhrase"], 10),
    "q27": lambda h, p: top_k(filter_rows(h, phrase()), ["EventTime", "SearchPhrase"], 10).select("SearchPhrase"),
    "q28": lambda h, p: top(
        filter_rows(group_aggregate(filter_rows(h, c("URL") != ""), ["CounterID"], l=F.avg(byte_length("URL")), c=n()), c("c") > p.having),
        ["CounterID"], "l", limit=25),
    "q29": lambda h, p: top(
        filter_rows(
            group_aggregate(
                filter_rows(h, c("Referer") != ""), [F.regexp_replace("Referer", HOST_PATTERN, "$1").alias("k")],
                l=F.avg(byte_length("Referer")), c=n(), mr=F.min("Referer"),
            ), c("c") > p.having),
        ["k"], "l", limit=25),
    "q30": q30,
    "q31": lambda h, p: refreshes(filter_rows(h, phrase()), "SearchEngineID", "ClientIP"),
    "q32": lambda h, p: refreshes(filter_rows(h, phrase()), "WatchID", "ClientIP"),
    "q33": lambda h, p: refreshes(h, "WatchID", "ClientIP"),
    "q34": lambda h, p: counted(h, "URL"),
    "q35": lambda h, p: project(counted(h, "URL"), one=F.lit(1), URL="URL", c="c"),
    "q36": q36,
    "q37": lambda h, p: views(filter_rows(h, month(p, c("DontCountHits") == 0, c("IsRefresh") == 0, c("URL") != "")), ["URL"]),
    "q38": lambda h, p: views(filter_rows(h, month(p, c("DontCountHits") == 0, c("IsRefresh") == 0, c("Title") != "")), ["Title"]),
    "q39": lambda h, p: views(filter_rows(h, month(p, c("IsRefresh") == 0, c("IsLink") != 0, c("IsDownload") == 0)), ["URL"], p.offset),
    "q40": q40,
    "q41": lambda h, p: views(
        filter_rows(h, month(p, c("IsRefresh") == 0, c("TraficSourceID").isin(-1, 6), c("RefererHash") == 3594120000172545465)),
        ["URLHash", "EventDate"], p.offset_hash),
    "q42": lambda h, p: views(
        filter_rows(h, month(p, c("IsRefresh") == 0, c("DontCountHits") == 0, c("URLHash") == 2868770270353813622)),
        ["WindowClientWidth", "WindowClientHeight"], p.offset_window),
    "q43": q43,
}


def run(name: str, table: DataFrame, params: Params = Params()) -> DataFrame:
    """One query over a ``hits``-shaped table."""
    return PLANS[name](table, params)
