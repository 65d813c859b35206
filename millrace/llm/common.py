"""What several operators share: lineage cuts, words, and a guard for column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import delete, shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a bitmap for each key, and in all: 2**26 bits are 8 MB.
BITS_A_KEY = 32
MAX_BITS = 1 << 26
#: Tasks a core, and rows of a small table in a file.
WAVES = 8
FILE_ROWS = 50_000


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder, of ``files`` files at most."""
    shared_folder(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)


def waves(spark: SparkSession) -> int:
    """A number of partitions that keeps all cores busy WAVES times; more make nothing shorter, but a file each."""
    return WAVES * spark.sparkContext.defaultParallelism


def files_for(rows: int) -> int:
    """How many files so many rows of a small table are."""
    return max(1, -(-rows // FILE_ROWS))


def release(*frames: DataFrame) -> None:
    """Deletes the files of the checkpoints that these frames read. Nothing may read them any more."""
    for df in frames:
        spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.nodeName() == "LogicalRDD" and (file := leaf.rdd().getCheckpointFile()).isDefined():
                delete(spark, file.get())


def maybe_in(key: Column, keys: DataFrame, name: str) -> Column:
    """False for most BIGINT keys that are not in ``keys`` (column ``name``), true for all that are.

    A bitmap of a size that is fixed by the number of keys, up to MAX_BITS; beyond that it
    lets more through. It is a filter in front of a join, which decides.
    """
    most = min(MAX_BITS, BITS_A_KEY * max(1, keys.count()))
    words = 1 << max(0, (most // 64 - 1).bit_length())
    own = F.col(name).cast("bigint")
    told = keys.filter(own.isNotNull()).select(_word(F.xxhash64(own), words).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.xxhash64(own))).alias("bits"))
    every = told.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits")))
    table = every.groupBy("w").agg(F.bit_or("bits").alias("bits")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("table"))
    hashed = F.xxhash64(key.cast("bigint"))
    return F.getbit(F.get(table.scalar(), _word(hashed, words).cast("int")), _bit(hashed)) == 1


def split_by(rows: DataFrame, key: str, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(apart, rest): rows whose key is surely not among ``keys`` and need no shuffle, and all others."""
    may = F.coalesce(maybe_in(F.col(key), keys, name), F.lit(True))
    return rows.filter(~may), rows.filter(may)


def _word(hashed: Column, words: int) -> Column:
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(words - 1).cast("bigint"))


def _bit(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
