"""Mixing sources to target weights by Sainte-Laguë apportionment.

Built-in functions only. Targets: the sources share BUDGET times all words by their weights;
a target stops at CAP times its source's size and the excess goes to the others by weight,
until none is above. The words are dealt out in equal blocks: quotas are given to sources, and
then within a source to its shards, by the highest quotients target / (2 * quota + 1). A
quota is read off its divisor (round(weight * seats / total)) and only the few seats by which
the roundings miss the total are settled by ranking quotients, so no block is ever a row.

Within a shard the documents stand in an order shuffled by SEED and are cut into blocks;
the shard takes every block as often as its quota fills whole passes, and the first blocks
once more for the rest. Shards hold about SHARD_ROWS rows, so a source of any size is many
shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, files_for, waves, word_count

BUDGET = 1.5
CAP = 2
WEIGHTS = (5, 2, 1)
SEED = 42
SHARD_ROWS = 20_000
#: A source with over 1 / LARGE of all rows is broadcast to them.
LARGE = 50_000
#: A block is this many words at most; it is smaller where the smallest target has under MIN_BLOCKS of them.
BLOCK = 256
MIN_BLOCKS = 64


def weights(sources: DataFrame, cycle: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the sources in code point order, null last, take the cycle's weights in turn.

    The rank is taken in two steps, so that no task sorts all sources: a source's place among
    those with its first two characters, after the sources with smaller ones.
    """
    head = F.substring("source", 1, 2)
    marked = sources.withColumn("head", head)
    heads = marked.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    before = heads.withColumn("before", F.sum("n").over(Window.orderBy(F.asc_nulls_last("head")).rowsBetween(Window.unboundedPreceding, -1)))
    place = marked.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(F.asc_nulls_last("source"))))
    joined = place.join(F.broadcast(before.select(F.col("head").alias("h"), F.coalesce("before", F.lit(0)).alias("before"))), F.col("head").eqNullSafe(F.col("h")))
    turn = F.pmod(F.col("before") + F.col("place") - 1, F.lit(len(cycle)))
    weight = reduce(lambda c, i: c.when(turn == i, F.lit(float(cycle[i]))), range(1, len(cycle)), F.when(turn == 0, F.lit(float(cycle[0]))))
    return joined.withColumn("weight", weight).drop("head", "h", "before", "place")


def targets(sources: DataFrame, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source_size, weight). Each round fixes the sources above their cap and shares anew."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, fixed = 0.0, None
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        over = F.col("weight") * F.lit(share) > limit
        capped, open_weight, n = sources.agg(
            F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        left = budget * total - cap * (capped or 0)
        if not open_weight or n == fixed:  # no further source reached its cap
            break
        share, fixed = left / open_weight, n
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(share) > limit, limit).otherwise(F.col("weight") * F.lit(share)))


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str, files: int | None = None) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt to its rows by the highest quotients weight / (2 * quota + 1).

    files: how many the rows are kept in meanwhile.

    Ties go to the smaller ``key``. Rounding weight * seats / total misses the seats by at most
    half the group's rows; a row gains or loses at most its share of that and one more, which
    are the only quotients ranked.
    """
    marked = rows.withColumn("g", F.struct(*group) if group else F.lit(0))
    sums = marked.groupBy("g").agg(F.sum(F.col(weight).cast("decimal(38,10)")).cast("double").alias("all"), F.count(F.when(F.col(weight) > 0, 1)).alias("members"))
    sums = F.broadcast(sums) if not group else sums
    share = F.when(F.col("all") > 0, F.col(weight) / F.col("all")).otherwise(0.0)
    dealt = marked.join(sums, marked.g.eqNullSafe(sums.g)).drop(sums.g).withColumn("share", share)
    dealt = cut(dealt.withColumn("first", F.floor(F.col("share") * F.col(seats) + 0.5).cast("bigint")), files)
    missing = dealt.groupBy("g").agg((F.max(seats) - F.sum("first")).alias("missing")).filter("missing <> 0")
    steps = F.ceil(F.col("share") * F.col("members") / 2).cast("bigint") + 1
    odd = dealt.join(F.broadcast(missing) if not group else missing, dealt.g.eqNullSafe(missing.g)).drop(missing.g).filter(F.col(weight) > 0)
    odd = odd.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), steps)))
    up = F.col("missing") > 0
    odd = odd.filter(up | (F.col("first") >= F.col("k")))
    quotient = F.col(weight) / F.when(up, 2 * (F.col("first") + F.col("k")) - 1).otherwise(2 * (F.col("first") - F.col("k")) + 1)
    odd = odd.withColumn("by", F.when(up, -quotient).otherwise(quotient))
    order = [F.col("by"), *[F.when(up, F.struct(F.col(c).isNull(), c)) for c in key], *[F.when(~up, F.struct(F.col(c).isNull(), c)).desc() for c in key], F.col("k")]
    odd = odd.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= F.abs("missing"))
    change = odd.groupBy(*[F.col(c).alias(f"{c}_") for c in [*group, *key]]).agg(F.sum(F.signum("missing").cast("bigint")).alias("change"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*group, *key]])
    out = dealt.join(change, same, "left").withColumn("quota", F.col("first") + F.coalesce("change", F.lit(0)))
    return out.select(*rows.columns, "quota")


def with_source(sized: DataFrame, sources: DataFrame, large: int = LARGE) -> DataFrame:
    """The rows (source, ...) with the columns of their source (source, rows, ...) but ``rows``.

    Sources with over 1 / ``large`` of all rows, of which there are less than ``large``, are
    broadcast, so that none of their rows is shuffled; the others are joined by a shuffle in
    which no source has more than that share.
    """
    side = sources.withColumnRenamed("source", "s")
    total = sources.agg(F.sum("rows")).first()[0] or 0
    big = F.col("rows") * large > total
    few = side.filter(big).drop("rows").withColumn("large", F.lit(True))
    met = sized.join(F.broadcast(few), sized.source.eqNullSafe(few.s), "left")
    rest = met.filter("large is null").select(*sized.columns)
    many = side.filter(~big).drop("rows")
    joined = rest.join(many, rest.source.eqNullSafe(many.s)).drop("s")
    return met.filter("large").drop("s", "large").unionByName(joined)


def shuffled(seed: int) -> list[Column]:
    """Order of documents within a shard; ties (repeated rows) by size, which is all that matters then."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), F.col("doc_id"), F.col("size"), F.col("row")]


def mix(docs: DataFrame, seed: int = SEED, shard_rows: int = SHARD_ROWS, row: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, row) for each row of ``docs`` (doc_id, text, source, more).

    size: words of the text, 0 for null or empty. taken: words that the mix takes, repeats
    counted: ``taken div size`` whole passes, and the first ``taken % size`` words once more.
    A null source is a source. Sources without a word have target 0; without any word nothing
    is taken. Rows that repeat a doc_id are documents of their own. Reruns agree.

    The tables of sources and shards are kept in as few files as they need, and none in more
    than a few a core: on a local file system the JVM starts two processes for each.
    """
    most = waves(docs.sparkSession)
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (row if row is not None else F.lit(0)).alias("row")), most)
    few = files_for(sized.agg(F.approx_count_distinct("source")).first()[0])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = cut(targets(cut(weights(totals), few)), few)
    shard_count = F.ceil(F.col("rows") / F.lit(shard_rows)).cast("int")
    low, whole, shards_in_all = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("target"), F.sum(shard_count)).first()
    block = int(max(1, min(BLOCK, (low or 0) / MIN_BLOCKS)))
    seats = int(round((whole or 0) / block))
    quotas = sainte_lague(sources.withColumn("seats", F.lit(seats).cast("bigint")), [], ["source"], "target", "seats", few)
    quotas = quotas.withColumn("shards", shard_count).drop("seats", "weight")

    placed = with_source(sized, quotas.withColumnsRenamed({"quota": "source_quota"}))
    placed = placed.withColumn("shard", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.col("shards")).cast("int"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_size", "source_quota", files_for(shards_in_all or 0))
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("h"), F.col("shard_size").cast("bigint").alias("shard_size"), "quota")

    known = placed.join(shards, placed.source.eqNullSafe(shards.s) & (placed.shard == shards.h)).drop("s", "h")
    own = Window.partitionBy("source", "shard").orderBy(*shuffled(seed)).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("size").over(own), F.lit(0))
    words = F.least(F.col("quota") * block, F.col("shard_size") * CAP)
    passes = F.when(F.col("shard_size") > 0, F.call_function("div", words, F.nullif("shard_size", F.lit(0)))).otherwise(0)
    rest = words - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begun")))
    return known.withColumn("begun", begun).select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "row").coalesce(most)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space kept."""
    return F.rtrim(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*)"), F.lit(1)), F.lit(1), n.cast("int")), ""))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``: a row for each pass.

    A document is repeated for each whole pass; a part is its first words. n_chars, where
    there is such a column, is that of the row's text. Rows without doc_id, or that share one,
    are documents of their own; rows alike in every column take as much as each other, the
    mean of what the mix gives them, rounded down.
    """
    rows = docs.columns
    content = F.xxhash64(*[F.col(f"`{c}`") for c in rows])
    each = mix(docs, row=content, **parameters).groupBy("doc_id", "row").agg(F.max("size").alias("taken_size"), F.call_function("div", F.sum("taken"), F.count(F.lit(1))).alias("taken"))
    taken = each.filter("taken > 0").select(F.col("doc_id").alias("taken_id"), F.col("row").alias("taken_row"), "taken_size", "taken")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rows]).alias("row"), F.col("doc_id").alias("own_id"), content.alias("own_row"))
    joined = own.join(taken, (F.col("own_row") == F.col("taken_row")) & F.col("own_id").eqNullSafe(F.col("taken_id")))
    passes = joined.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("taken") - 1, F.col("taken_size")))))
    left = F.col("taken") - F.col("i") * F.col("taken_size")
    text = F.when(left >= F.col("taken_size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), left))
    out = passes.select(text.alias("text"), "row")
    own = {"text": F.col("text")}
    if "n_chars" in rows:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[own[c] if c in own else F.col(f"row.`{c}`") for c in rows])
