"""Fuzzy line dedup by MinHash; built-in functions only.

1. Lines of equal text are one class from the start, named by 128 bits of hashes.
2. A line's shingles are its runs of SHINGLE characters (a shorter line is one shingle). A
   shingle is hashed once; exclusive-or with SIDE * SIDE constants gives as many permutations,
   whose minima, taken before any shuffle, are the signature. Shingles are cut from the line
   in UTF-32, so that reaching into a long line costs nothing.
3. The minima stand in a square; its rows and columns are the bands. Lines
   that agree in a band meet in a bucket.
4. Pairs are verified by the exact Jaccard similarity of their sets of shingles (each shingle
   as 64 bits of hash: two lines of n shingles are misjudged with a chance of n * n / 2**64).
   Before that a bitmap filter rules pairs out: a set's bitmap of WORDS * 64 bits has the parity
   of the shingles that fall on each bit, so sets whose bitmaps differ in d bits differ in at
   least d shingles. No similar pair is lost to it. The links found so far make components, and
   only pairs across components are compared: first each line with the least of all its
   buckets' lines, then, as long as a bucket holds several components, the HEADS first lines
   of it with all others, then the next ones up to WIDER times as many, until all pairs
   across components were tried. So a group of similar lines is one component before the many
   pairs within it would be formed.
5. A bucket's pairs are formed by pairs of chunks of CHUNK lines, so no task has all of them.
   Two lines are compared in one of their buckets only, and within the join, which returns
   links and no candidates.
6. The verified pairs' connected components are found, and of each component the first line
   (smallest doc_id, then place) stays.

Of the pairs with a similarity of 0.8 about 98 % meet, of those with 0.85 over 99 %, of
those with 0.9 practically all.

Buckets carry one hash of a line (64 bits). Lines that share it are told apart when
their texts are fetched: each text is a node of its own, and they are compared too. Only
lines that meet another need their text; a bitmap of at most MAX_BITS bits keeps most others
from the shuffle, and the join that follows is exact whatever the bitmap lets through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, maybe_in, release, split_by
from millrace.llm.components import connected_components

SHINGLE = 8
SIMILARITY = 0.8
SIDE = 4
#: Shingles hashed for one row of the aggregation.
STRIDE = 4
#: Lines of a bucket that are compared with all others in the first round.
HEADS = 4
#: How many times as many lines of a bucket are compared with its others in the next round.
WIDER = 32
#: Words of 64 bits of a set's bitmap.
WORDS = 16
#: Lines of a bucket whose pairs with as many others are formed under one key.
CHUNK = 1024
#: Keys of buckets that are sorted together, about.
TOGETHER = 1 << 19
#: A key that HOT of every SAMPLED-th lines have is known to be of several, and is not sorted.
HOT, SAMPLED = 8, 1024


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place, line): what is between line ends; a null text has none."""
    # no array here is empty; the outer form keeps Spark from splitting once more for a filter on its size
    split = F.posexplode_outer(F.split(F.col("text").cast("string"), "\n"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null").select("doc_id", split.alias("place", "line"))


def blank(line: Column) -> Column:
    # stops at the first other character, where a regular expression has the line copied first
    return F.ltrim(line, F.lit(" \t\n\v\f\r")) == ""


def name(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("id"), F.xxhash64(F.lit("line"), line).alias("more")]


def count_of(raw: Column, shingle: int) -> Column:
    """How many shingles (repeats included) a line in UTF-32 has."""
    return F.greatest(F.lit(1), (F.length(raw) / 4).cast("int") - (shingle - 1))


def shingles(line: Column, shingle: int) -> Column:
    """The hashes of a line's shingles, repeats included."""
    # as the variable of a lambda the bytes are not copied for every shingle
    raw = F.array(F.encode(line, "UTF-32"))
    return F.transform(raw, lambda b: F.transform(F.sequence(F.lit(1), count_of(b, shingle) * 4 - 3, F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * shingle)))))[0]


def signatures(named: DataFrame, shingle: int) -> DataFrame:
    """(id, more, n, h0, h1, ...): a row for each distinct (id, more, line), and on how many rows it is. Only numbers are aggregated."""
    told = named.select("id", "more", F.encode("line", "UTF-32").alias("raw"))
    told = told.select("id", "more", "raw", (count_of(F.col("raw"), shingle) * 4 - 3).alias("last"))
    told = told.select("id", "more", "raw", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STRIDE))).alias("at"))
    # beyond the end the last shingle is taken again, which changes no minimum
    hashed = [F.hash(F.substring("raw", lesser(F.col("at") + 4 * j, F.col("last")), F.lit(4 * shingle))).alias(f"s{j}") for j in range(STRIDE)]
    # minima of pairs, then of these: comparisons without branches, each made once
    of = [[F.col(f"s{j}").bitwiseXOR(F.lit(mask(i))) for j in range(STRIDE)] for i in range(SIDE * SIDE)]
    once = F.when(F.col("at") == 1, 1).alias("once")  # of each line's rows the first
    halves = told.select("id", "more", once, *hashed).select("id", "more", "once", *[lesser(of[i][j], of[i][j + 1]).alias(f"p{i}_{j}") for i in range(SIDE * SIDE) for j in (0, 2)])
    return halves.groupBy("id", "more").agg(F.count("once").alias("n"), *[F.min(lesser(F.col(f"p{i}_0"), F.col(f"p{i}_2"))).alias(f"h{i}") for i in range(SIDE * SIDE)])


def lesser(a: Column, b: Column) -> Column:
    """The lesser of two numbers that are not null."""
    return F.call_function("if", a < b, a, b)


def bands() -> list[list[int]]:
    """Rows and columns of the square of minima."""
    side = range(SIDE)
    return [[i * SIDE + j for j in side] for i in side] + [[j * SIDE + i for j in side] for i in side]


def mask(i: int) -> int:
    """The i-th of a fixed sequence of 32-bit constants."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (z ^ (z >> 31)) % (1 << 32) - (1 << 31)


def keyed(signed: DataFrame) -> DataFrame:
    """(id, more, n, k0, k1, ...): of the rows (id, more, n, h0, h1, ...) the key of the bucket in each band."""
    return signed.select("id", "more", "n", *[F.xxhash64(F.lit(n), *[f"h{i}" for i in band]).alias(f"k{n}") for n, band in enumerate(bands())])


def of_several(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(several, hot): together at least the keys (key) that stand on several of the rows (id, k0, k1, ...); hot has those of very many.

    Keys are collected by their remainders and sorted, so that equal ones are neighbours: they
    travel as arrays, where rows of one key each cost more to shuffle than to compare. The hot
    ones are told by a sample first, so no array grows with a bucket; the sample decides nothing else.
    """
    key = F.explode(F.array(*[f"k{n}" for n in range(len(bands()))])).alias("key")
    sampled = cut(signed.filter(F.pmod("id", F.lit(SAMPLED)) == 0))
    hot = cut(sampled.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT).select("key"))
    groups = 1 + sampled.count() * SAMPLED * len(bands()) // TOGETHER
    release(sampled)
    apart = signed.select(key).filter(~maybe_in(F.col("key"), hot, "key"))
    held = apart.groupBy(F.pmod("key", F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    each = held.select("keys", F.posexplode("keys").alias("at", "key"))
    # of equal neighbours the first
    first = ~F.get("keys", F.col("at") - 1).eqNullSafe(F.col("key"))
    return cut(each.filter((F.get("keys", F.col("at") + 1) == F.col("key")) & first).select("key")), hot


def met(signed: DataFrame) -> DataFrame:
    """(key, id, place): the rows (id, k0, k1, ...) of each bucket with several, but the first, numbered from 2; and its least ``lead``.

    Most buckets hold one row. The keys of those with several are found first, and a bitmap keeps
    most other rows from the shuffle. The leader is the first row of a running window, so a bucket
    is streamed, not held. The order is the same in all buckets, so lines that share several
    share a leader.
    """
    key = F.explode(F.array(*[f"k{n}" for n in range(len(bands()))])).alias("key")
    several, hot = of_several(signed)
    # one bitmap for both: most rows are in neither
    rows = signed.select("id", key).filter(maybe_in(F.col("key"), several.unionByName(hot), "key"))
    order = Window.partitionBy("key").orderBy("id")
    own = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut(rows.select("key", F.first("id").over(own).alias("lead"), "id", F.row_number().over(order).alias("place")).filter("place > 1"))
    release(several, hot)
    return found


def named_lines(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, more, doc_id, place, line): the lines (doc_id, place, line) by name, a blank one without. Those whose ``id`` may be wanted (id) keep their text."""
    told = every.select(*[F.when(~blank(F.col("line")), c).alias(n) for c, n in zip(name(F.col("line")), ("id", "more"), strict=True)], "doc_id", "place", "line")
    return told.withColumn("line", F.when(maybe_in(F.col("id"), wanted, "id"), F.col("line")))


def texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, id, more, line): a numbered row for each text among the rows of named_lines() whose ``id`` is wanted (id)."""
    # most lines that meet no other have no text; the join decides
    one = named.filter("line is not null").select("id", "more", "line").join(wanted, "id", "left_semi").groupBy("id", "more").agg(F.min("line").alias("line"))
    # a checkpoint, so that the numbers stay what they are
    return cut(one.select(F.monotonically_increasing_id().alias("node"), "id", "more", "line"))


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, w0, w1, ...) of each text (node, line): how many distinct shingles it has, and on each of WORDS * 64 bits the parity of those that fall there."""
    # the outer form, as in lines(); the lambda stays out of the generator, which is compiled then
    sets = texts.select("node", F.array_distinct(shingles(F.col("line"), shingle)).alias("hs")).withColumn("size", F.size("hs"))
    told = sets.select("node", "size", "hs", F.explode_outer(F.sequence(F.lit(0), F.col("size") - 1, F.lit(STRIDE))).alias("at"))
    zero = F.lit(0).cast("bigint")
    told = told.select("node", "size", "at", *[F.coalesce(F.get("hs", F.col("at") + j), zero).alias(f"h{j}") for j in range(STRIDE)])
    # several shingles a row, as in signatures(); beyond the end there is no bit
    bit = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(f"h{j}").bitwiseAND(F.lit(63)).cast("int")) for j in range(STRIDE)]
    bits = [F.call_function("if", F.col("at") + j < F.col("size"), bit[j], zero).alias(f"b{j}") for j in range(STRIDE)]
    of = [F.shiftrightunsigned(f"h{j}", 6).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias(f"of{j}") for j in range(STRIDE)]
    told = told.select("node", "size", *of, *bits)
    word = [reduce(Column.bitwiseXOR, [F.call_function("if", F.col(f"of{j}") == i, F.col(f"b{j}"), zero) for j in range(STRIDE)]) for i in range(WORDS)]
    return told.groupBy("node", "size").agg(*[F.bit_xor(w).alias(f"w{i}") for i, w in enumerate(word)])


def may_be_similar(threshold: float) -> Column:
    """False only for pairs of sets (size, w0, ...; size_, w0_, ...) whose similarity is below.

    Sets of m and n shingles of Jaccard similarity t differ in (m + n) * (1 - t) / (1 + t) of them.
    """
    size, size_ = F.col("size"), F.col("size_")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"w{i}_"))) for i in range(WORDS)])
    return (F.least(size, size_) >= threshold * F.greatest(size, size_)) & (apart * (1 + threshold) <= (size + size_) * (1 - threshold) + 1e-6)


def are_similar(shingle: int, threshold: float) -> Column:
    """Whether the Jaccard similarity of two lines (line, size; line_, size_) reaches the threshold."""
    both = F.size(F.array_intersect(shingles(F.col("line"), shingle), shingles(F.col("line_"), shingle)))
    # compared with a number, not within a lambda: so the intersection is compiled, over plain longs, and made once
    return both >= least_shared(F.col("size") + F.col("size_"), threshold)


def least_shared(sizes: Column, threshold: float) -> Column:
    """The least n with n >= threshold * (sizes - n): so many elements must two sets of ``sizes`` together share."""
    n = F.floor(sizes * (threshold / (1 + threshold))).cast("int")
    # rounding may be off by one either way
    return F.coalesce(*[F.when(n + d >= threshold * (sizes - n - d), n + d) for d in (-1, 0, 1)], n + 2)


def other(rows: DataFrame) -> DataFrame:
    """The same rows as the second of a pair."""
    return rows.withColumnsRenamed({c: f"{c}_" for c in rows.columns})


def similar(pairs: DataFrame, about: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of the distinct pairs of nodes (a, b) whose texts are similar enough."""
    met = pairs.join(about, F.col("a") == F.col("node")).join(other(about), F.col("b") == F.col("node_"))
    return met.filter(may_be_similar(threshold) & are_similar(shingle, threshold)).select("a", "b")


def in_buckets(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, place, n): all rows of the buckets of met(), the leaders included, by the nodes (id, node)."""
    whole = buckets.select("key", "id", "place").unionByName(buckets.filter("place = 2").select("key", F.col("lead").alias("id"), F.lit(1).alias("place")))
    n = buckets.groupBy("key").agg(F.max("place").alias("n"))
    return cut(whole.join(nodes, "id").join(n, "key").select("key", "node", "place", "n"))


def mixed(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """The rows (key, node, ...) with their component ``c``, of the buckets that hold several."""
    owned = rows.join(tied, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    several = owned.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    return owned.join(several, "key")


def across(rows: DataFrame, past: int, until: int, shingle: int, threshold: float) -> DataFrame:
    """Distinct similar pairs of nodes (a, b) in different components: of each bucket the lines in places ``past`` to ``until``, the first left out, with all from there on.

    Chunk i of a bucket's lines meets chunk j. Two lines are compared in the first only of the
    buckets (``keys``) that they share, and the join returns nothing but similar pairs.
    """
    own = rows.filter(F.col("place") > past).withColumn("own", F.floor(F.col("place") / F.lit(CHUNK)).cast("int"))
    first, last = F.lit((past + 1) // CHUNK), F.floor(F.col("n") / F.lit(CHUNK)).cast("int")
    low = own.filter(F.col("place") <= until).withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", last)))
    high = other(own.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(first, F.least("own", F.lit(until // CHUNK))))))
    # nodes whose lines share a hash share their place
    ahead = (F.col("place") < F.col("place_")) | ((F.col("place") == F.col("place_")) & (F.col("node") < F.col("node_")))
    here = F.array_min(F.array_intersect("keys", "keys_")) == F.col("key")
    fits = (F.col("c") != F.col("c_")) & ahead & may_be_similar(threshold) & here & are_similar(shingle, threshold)
    pairs = low.join(high, [F.col(k) == F.col(f"{k}_") for k in ("key", "i", "j")] + [fits])
    return pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def similar_lines(every: DataFrame, shingle: int = SHINGLE, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, more, component) of the distinct lines (doc_id, place, line) that are similar to others, (id, more) of those that stand in several places, and all lines by name: named_lines()."""
    signed = cut(keyed(signatures(every.filter(~blank(F.col("line"))).select(*name(F.col("line")), "line"), shingle)))
    repeated = cut(signed.filter("n > 1").select("id", "more"))
    buckets = met(signed)
    release(signed)
    wanted = cut(buckets.select(F.explode(F.array("lead", "id")).alias("id")).distinct())
    # the texts are split a last time; what follows reads names, and the texts of lines that meet
    every = cut(named_lines(every, wanted))
    texts = texts_of(every, wanted)
    nodes = texts.select("id", "node")
    rows = in_buckets(buckets, nodes)
    keys = rows.groupBy("node").agg(F.collect_set("key").alias("keys"))
    about = cut(texts.select("node", "line").join(described(texts, shingle), "node").join(keys, "node"))

    first = buckets.groupBy("id").agg(F.min("lead").alias("lead"))
    pairs = first.join(nodes.select("id", F.col("node").alias("b")), "id").join(nodes.select(F.col("id").alias("lead"), F.col("node").alias("a")), "lead")
    # nodes that share a hash share their buckets, and their leader may be themselves
    distinct = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tied = connected_components(similar(distinct, about.drop("keys"), shingle, threshold))
    past, until = 0, HEADS
    while True:
        left = cut(mixed(rows.filter(F.col("n") > past), tied))
        if left.isEmpty():
            release(left)
            break
        links = across(left.join(about, "node"), past, until, shingle, threshold)
        found = connected_components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        release(tied, left)
        tied, past, until = found, until, until * WIDER
    found = cut(texts.select("node", "id", "more").join(tied, "node").select("id", "more", "component"))
    release(buckets, wanted, texts, rows, about, tied)
    return found, repeated, every


def line_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, place, kept, first_doc_id, first_place) for each line of ``docs`` (doc_id, text, more).

    place counts from 0. first_*: the line of the same component that stays, itself included;
    kept: whether this is it. A blank line is kept and is its own first. A null text has no
    lines, an empty one has one (blank). Rows that repeat a doc_id share its places: equal
    lines in the same place are one line, and there is a row for each. Rows without doc_id are
    left out. Other columns are ignored; an empty table gives an empty result.
    """
    found, repeated, named = similar_lines(lines(docs), shingle, threshold)
    # classes of one line that no other is similar to need nothing more
    several = cut(found.unionByName(repeated, allowMissingColumns=True).groupBy("id", "more").agg(F.max("component").alias("component")))
    # a bitmap keeps most other classes from the aggregation; the join decides
    owns = named.filter(maybe_in(F.col("id"), several, "id")).groupBy("id", "more").agg(F.min(F.struct("doc_id", "place")).alias("own"))
    tied = cut(several.join(owns, ["id", "more"]))
    firsts = tied.filter("component is not null").groupBy("component").agg(F.min("own").alias("shared"))
    known = cut(tied.join(firsts, "component", "left").select("id", "more", F.coalesce("shared", "own").alias("first")))
    release(found, repeated, several, tied)
    own, columns = F.struct("doc_id", "place"), ["doc_id", "place", "kept", "first_doc_id", "first_place"]
    may = F.coalesce(maybe_in(F.col("id"), known, "id"), F.lit(False))
    apart = named.filter(~may).withColumns({"kept": F.lit(True), "first_doc_id": F.col("doc_id"), "first_place": F.col("place")})
    met_again = named.filter(may).join(known, ["id", "more"], "left").withColumn("first", F.coalesce("first", own))
    rest = met_again.withColumns({"kept": F.col("first") == own, "first_doc_id": F.col("first.doc_id"), "first_place": F.col("first.place")})
    return apart.select(*columns).unionByName(rest.select(*columns))


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their columns, without the lines that are not kept.

    A document that loses every line that is not blank goes; one that had none stays as it is, as
    does a row without doc_id. Rows that share a doc_id share its places: what goes from one
    goes from all. The text is rebuilt only where a line goes, and n_chars with it where there
    is such a column. Only documents that may lose a line are shuffled.
    """
    groups = line_groups(docs, **parameters)
    gone = cut(groups.filter("not kept").groupBy("doc_id").agg(F.collect_set("place").alias("gone")).withColumnRenamed("doc_id", "gone_id"))
    release(groups)
    apart, met = split_by(docs, "doc_id", gone, "gone_id")
    joined = met.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id")).join(gone, F.col("own_id") == F.col("gone_id"), "left")
    split = joined.select("row", "gone", F.split("row.text", "\n").alias("own_lines"))
    joined = split.withColumn("places", F.array_except(F.sequence(F.lit(0), F.size("own_lines") - 1), "gone"))
    rest = F.transform("places", lambda i: F.get("own_lines", i))
    whole = F.col("gone").isNull()
    cleaned = joined.select("row", whole.alias("whole"), F.when(whole, F.col("row.text")).otherwise(F.array_join(rest, "\n")).alias("text"))
    cleaned = cleaned.filter(F.col("whole") | ~blank(F.col("text")))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return apart.unionByName(cleaned.select(*[own[c] if c in own else F.col(f"row.`{c}`") for c in docs.columns]))
