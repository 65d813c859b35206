"""Connected components by alternating large-star and small-star rounds.

DataFrame operations only. A hub is pre-aggregated before its shuffle (its minimum) and
met again in a join, whose large partitions Spark can split, so one node may have most of
the edges. Every round is checkpointed, and the
round before it deleted; the number of rounds grows with the logarithm of
the longest chain. Once ONE_TASK edges or fewer are left (they are counted each round), a
round runs over a single partition, broadcasts at most as many rows and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, release

ONE_TASK = 100_000


def _ends(u1: str, v1: str, u2: str, v2: str, u: str, v: str) -> Column:
    """Two rows of each: (u1, v1) and (u2, v2)."""
    return F.inline(F.array(F.struct(F.col(u1).alias(u), F.col(v1).alias(v)), F.struct(F.col(u2).alias(u), F.col(v2).alias(v))))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select(_ends("hi", "lo", "lo", "hi", "u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node, and its neighbours below, are tied to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(F.broadcast(least) if few else least, "hi").select(_ends("lo", "m", "hi", "m", "hi", "lo"))
    return moved.filter("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    Nodes are of any orderable type. Loops, repeated edges and edges with a null end say
    nothing; without other edges the result is empty.
    """
    pair = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = cut(pair.filter("a is not null and b is not null and lo < hi").select("hi", "lo").distinct())
    state = _state(now)
    while state[0]:
        few = state[0] <= ONE_TASK
        before, past = state, now
        now = cut(_small_star(_large_star(now.coalesce(1) if few else now, few), few))
        release(past)
        state = _state(now)
        if state == before:
            break
    return now.select(_ends("hi", "lo", "lo", "lo", "node", "component")).distinct()
