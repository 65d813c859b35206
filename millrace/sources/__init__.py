"""Sources and sinks: CSV without NULLs, Parquet as the native store, valid CSV results."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

#: Dialect: no header, comma, doubled quotes inside quoted fields.
_CSV = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "header": "false"}


def fill_defaults(df: DataFrame) -> DataFrame:
    """The store has no NULLs: '' for text, 0 for integers, 1970-01-01 for dates and times."""
    default = {T.DateType: F.lit("1970-01-01").cast("date"), T.TimestampNTZType: F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        d = F.lit("") if isinstance(f.dataType, T.StringType) else default.get(type(f.dataType), F.lit(0).cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else None)
        out.append((F.coalesce(c, d) if d is not None else c).alias(f.name))
    return df.select(*out)


def csv_rows(reader: DataFrameReader | DataStreamReader, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Batch or stream: short rows are padded with defaults and extra fields ignored; text that is no number, date or time raises.

    With ``multi_line`` a quoted field may hold line ends, and a file is one task; without, files
    are split.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = reader.schema(text).options(**_CSV, multiLine=multi_line).csv(path)
    typed = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c).cast(f.dataType)
        typed.append(c.alias(f.name))
    return fill_defaults(raw.select(*typed))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    return csv_rows(spark.read, path, schema, multi_line)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header and rows with valid quoting. ``single_file`` is for results that are known to be small."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, sep=",", quote='"', escape='"', emptyValue="")


def csv_to_parquet(spark: SparkSession, source: str, schema: T.StructType, target: str, multi_line: bool = True) -> None:
    read_csv(spark, source, schema, multi_line).write.mode("overwrite").parquet(target)
