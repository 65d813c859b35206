"""The click-stream table ``hits``, derived from ``events``.

The expressions are the same text for Spark SQL and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import load

COLUMNS = {
    "WatchID": "event_id",
    "UserID": "user_id",
    "EventTime": "ts",
    "EventDate": "CAST(ts AS DATE)",
    "CounterID": "CAST(CASE WHEN event_id % 4 = 0 THEN 62 ELSE event_id % 50 END AS INT)",
    "ClientIP": "CAST(user_id * 17 % 512 AS INT)",
    "RegionID": "CAST(user_id % 25 AS INT)",
    "AdvEngineID": "CAST(CASE WHEN event_id % 9 < 6 THEN 0 ELSE event_id % 5 END AS SMALLINT)",
    "SearchEngineID": "CAST(event_id % 4 AS SMALLINT)",
    "TraficSourceID": "CAST(event_id % 9 - 1 AS SMALLINT)",
    "ResolutionWidth": "CAST(800 + event_id * 37 % 1200 AS SMALLINT)",
    "MobilePhone": "CAST(user_id % 7 AS SMALLINT)",
    "MobilePhoneModel": "CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN 'iPad' ELSE event_type END",
    "SearchPhrase": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(event_type, ' ', props) END",
    "URL": "CASE WHEN event_id % 11 = 0 THEN ''"
    " WHEN event_id % 5 = 0 THEN concat('http://www.google.com/', event_type, '/', CAST(event_id % 97 AS STRING))"
    " ELSE concat('https://site', CAST(user_id % 40 AS STRING), '.example.org/', event_type, '/é', CAST(event_id % 89 AS STRING)) END",
    "Title": "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 6 < 3 THEN concat('Google ', event_type) ELSE event_type END",
    "Referer": "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN concat('noscheme', CAST(user_id % 3 AS STRING))"
    " WHEN event_id % 7 = 2 THEN concat('https://bare', CAST(user_id % 3 AS STRING), '.org')"
    " ELSE concat('https://www.ref', CAST(user_id % 9 AS STRING), '.com/', event_type) END",
    "IsRefresh": "CAST(CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS SMALLINT)",
    "DontCountHits": "CAST(CASE WHEN event_id % 14 = 13 THEN 1 ELSE 0 END AS SMALLINT)",
    "IsLink": "CAST(CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END AS SMALLINT)",
    "IsDownload": "CAST(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS SMALLINT)",
    "URLHash": "CASE WHEN event_id % 8 < 3 THEN 2868770270353813622 ELSE event_id % 30 END",
    "RefererHash": "CASE WHEN event_id % 5 < 3 THEN 3594120000172545465 ELSE event_id % 30 END",
    "WindowClientWidth": "CAST(event_id % 31 * 40 AS SMALLINT)",
    "WindowClientHeight": "CAST(event_id % 23 * 30 AS SMALLINT)",
}

VIEW_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM events"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns a query does not use are pruned down to the Parquet scan of ``events``."""
    return load(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])
