"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Fit: a tree of BRANCH-way k-means splits over a bounded sample of the vectors (those of smallest
hash): DEPTH levels over SAMPLE vectors, and a level more over LARGE_SAMPLE once leaves would
hold over DEEPER vectors each. Index: every vector descends to its leaf, and the index is kept by leaf.
Search: a priority queue holds the tree's nodes by the inner product that they promise the
query, best first; inner nodes put their children into it, leaves are visited. How many leaves
are visited is calibrated: for at most PROBES sample queries the true neighbours among all
vectors are found, and the visits are widened until the mean share of them that lies in the
visited leaves reaches TARGET. The first visits give each query a bound, and the wider ones
send only what reaches it.

At most a block of queries is broadcast. More of them are dealt to the cells that they visit, a
cell being adjacent leaves, or a part of a large one, of bounded size: a task holds one cell
and the queries stream past it, so a look reads the index once however many queries there are.

The visits of a query are independent of the number of vectors; leaves grow with it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vectors
from millrace.llm.common import cut
from millrace.llm.vectors import Queries

K = 20
QUERY_EVERY = 20
SAMPLE = 8192
#: For large tables: so many vectors, and bytes, are sampled at most.
LARGE_SAMPLE = 131_072
SAMPLE_BYTES = 128 << 20
#: Vectors of a leaf on average from which the tree has a level more.
DEEPER = 4096
#: Vectors of a cell in bytes.
CELL_BYTES = 16 << 20
BRANCH = 16
DEPTH = 2
ROUNDS = 8
PROBES = 256
TARGET = 0.95
#: Vectors of one leaf that share a partition.
LEAF_ROWS = 20_000
#: A first look at one in so many of the leaves to be visited.
FIRST = 16


@dataclass
class Node:
    center: np.ndarray
    spread: float  # root mean square distance of the sample from the centre
    leaf: int = -1
    children: list[int] = field(default_factory=list)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int

    def __post_init__(self):
        self.centers = np.array([n.center for n in self.nodes])
        self.spreads = np.array([n.spread for n in self.nodes])

    def assign(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(v), np.int64)
        while True:
            moved = False
            for node in np.unique(at).tolist():
                children = np.array(self.nodes[node].children)
                if not len(children):
                    continue
                rows = np.flatnonzero(at == node)
                c = self.centers[children]
                at[rows] = children[np.argmin((c**2).sum(axis=1)[None, :] - 2 * v[rows] @ c.T, axis=1)]
                moved = True
            if not moved:
                return np.array([n.leaf for n in self.nodes])[at]

    def promises(self, q: np.ndarray) -> np.ndarray:
        """Per query and node the inner product to hope for: the centre's, and the spread in the query's direction."""
        return q @ self.centers.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.spreads[None, :]

    def best_bins(self, promise: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best first, and as many more as hold ``least`` vectors, by the leaves' sizes."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            node = self.nodes[heapq.heappop(queue)[1]]
            if node.leaf >= 0:
                out.append(node.leaf)
                held += 0 if sizes is None else int(sizes[node.leaf])
            for c in node.children:
                heapq.heappush(queue, (-promise[c], c))
        return out


def _kmeans(v: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centers = v[rng.choice(len(v), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmin((centers**2).sum(axis=1)[None, :] - 2 * v @ centers.T, axis=1)
        sums, sizes = np.zeros_like(centers), np.bincount(own, minlength=k)
        np.add.at(sums, own, v)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers, np.argmin((centers**2).sum(axis=1)[None, :] - 2 * v @ centers.T, axis=1)


def fit(sample: np.ndarray, branch: int = BRANCH, depth: int = DEPTH, seed: int = 42) -> Tree:
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(v: np.ndarray, center: np.ndarray, level: int) -> int:
        nonlocal leaves
        me = len(nodes)
        spread = float(np.sqrt(((v - center) ** 2).sum(axis=1).mean() / max(1, v.shape[1]))) if len(v) else 0.0
        nodes.append(Node(center, spread))
        if level == depth or len(v) < 2 * branch:
            nodes[me].leaf = leaves
            leaves += 1
            return me
        centers, own = _kmeans(v, branch, rng)
        for i in range(branch):
            if (own == i).any():
                nodes[me].children.append(grow(v[own == i], centers[i], level + 1))
        return me

    grow(sample, sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1]), 0)
    return Tree(nodes, leaves)


def _assigned(classes: DataFrame, tree, width: int) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, batch in vectors.batches_of(source, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("vec"), pa.array(tree.value.assign(v))], names=["cid", "vec", "leaf"])

    return classes.select("cid", "vec").mapInArrow(run, "cid bigint, vec array<double>, leaf bigint")


def _reaching(q: np.ndarray, qcid: np.ndarray, low: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of what may be among a query's k nearest and reaches its bound; none is a query's own class."""
    scores = q @ v.T
    scores[qcid[:, None] == ids[None, :]] = -np.inf
    scores[scores < (low - 1e-9 * (1 + np.abs(low)))[:, None]] = -np.inf
    at, c = vectors.near_top(scores, k)
    keep = scores[at, c] > -np.inf
    return at[keep], c[keep]


def _nearest(index: DataFrame, block, visits, bounds, width: int, k: int) -> DataFrame:
    """(qcid, cid, score, leaf): the k nearest found in each partition.

    visits: per leaf the queries (by place in the block) that look into it, or None for all
    queries everywhere. bounds: scores below a query's bound are not sent.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = block.value
        low = bounds.value if bounds is not None else np.full(len(own.cid), -np.inf)
        held = None
        for ids, v, batch in vectors.batches_of(source, width):
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            for one in np.unique(leaf).tolist() if visits is not None else [None]:
                who = np.arange(len(own.cid)) if one is None else visits.value.get(one)
                if who is None or not len(who):
                    continue
                at = np.arange(len(ids)) if one is None else np.flatnonzero(leaf == one)
                q, c = _reaching(own.vec[who], own.cid[who], low[who], v[at], ids[at], k)
                q, c = who[q], at[c]
                if not len(q):
                    continue
                new = (q, vectors.exact(own.vec[q], v[c]), ids[c], leaf[c])
                if held is not None:
                    new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                held = vectors.best(*new[:3], k, new[3])
        if held is not None:
            q, score, ids, leaf = held
            yield pa.RecordBatch.from_arrays([pa.array(own.cid[q]), pa.array(ids), pa.array(score), pa.array(leaf)], names=["qcid", "cid", "score", "leaf"])

    return index.mapInArrow(run, "qcid bigint, cid bigint, score double, leaf bigint")


def _kth(near: DataFrame, k: int) -> DataFrame:
    """(qcid, low): the k-th best score found so far, of the queries with k of them."""
    return near.groupBy("qcid").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("low")).filter("low is not null")


def _bounds(near: DataFrame, own: Queries, k: int) -> np.ndarray:
    """The k-th best score found so far, by place in the block; a number for each query of it."""
    place, low = {int(c): j for j, c in enumerate(own.cid)}, np.full(len(own.cid), -np.inf)
    for qcid, bound in _kth(near, k).collect():
        low[place[qcid]] = bound
    return low


def _block(spark, rows: DataFrame, width: int) -> Queries:
    """A bounded set of query classes, on the driver."""
    table = rows.select("cid", "vec").toArrow()
    order = np.argsort(table["cid"].to_numpy())
    return Queries(table["cid"].to_numpy()[order], vectors.matrix(table["vec"], width)[order] if table.num_rows else np.zeros((0, width)))


def cells(sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """(first cell, number of cells) of each leaf: adjacent leaves of up to ``rows`` vectors share one, a larger leaf has several."""
    out, cell, held = [], -1, rows
    for n in sizes.tolist():
        if held + n > rows:
            cell, held = cell + 1, 0
        own = max(1, -(-n // rows))
        out.append((cell, own))
        cell, held = cell + own - 1, held + n if own == 1 else rows
    return out


def _looks(asked: DataFrame, tree, leaf_cells: list[tuple[int, int]], looks: int, sizes: np.ndarray, least: int, width: int) -> DataFrame:
    """(qcid, vec, cell, early, leaves): the cells that a query visits and the leaves there; early: of its first visits."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = max(1, looks // FIRST)
        for ids, v, batch in vectors.batches_of(source, width):
            rows = []
            for i, promise in enumerate(tree.value.promises(v)):
                told: dict[tuple[int, bool], list[int]] = {}
                for place, leaf in enumerate(tree.value.best_bins(promise, looks, sizes, least)):
                    start, own = leaf_cells[leaf]
                    for cell in range(start, start + own):
                        told.setdefault((cell, place < first), []).append(leaf)
                rows += [(i, cell, early, leaves) for (cell, early), leaves in told.items()]
            for at in range(0, len(rows), vectors.STEP):
                i, cell, early, leaves = zip(*rows[at : at + vectors.STEP], strict=True)
                i = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids).take(i), batch.column("vec").take(i), pa.array(cell, pa.int64()), pa.array(early, pa.bool_()), pa.array(leaves, pa.list_(pa.int64()))],
                    names=["qcid", "vec", "cell", "early", "leaves"],
                )

    return asked.select("cid", "vec").mapInArrow(run, "qcid bigint, vec array<double>, cell bigint, early boolean, leaves array<bigint>")


def _met(members: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """(qcid, cid, score): the k nearest of each cell, of members (cell, leaf, cid, vec) for asked (cell, qcid, vec, leaves, low).

    A cell's members come first and are held; its queries stream past them.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, by_leaf = None, [], {}
        for ids, v, batch in vectors.batches_of(source, width, cid="id"):
            at, kind, leaf, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "leaf", "low"))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])]).tolist()
            for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):
                if at[lo] != cell:
                    cell, held, by_leaf = at[lo], [], {}
                if kind[lo] == 0:
                    held.append((leaf[lo:hi], ids[lo:hi], v[lo:hi]))
                    continue
                if held:
                    leaves, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                    starts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]]).tolist()
                    by_leaf = {int(leaves[a]): tuple(x[a:b] for x in rest) for a, b in zip(starts, [*starts[1:], len(leaves)], strict=True)}
                    held = []
                yield from one_run(ids[lo:hi], v[lo:hi], low[lo:hi], batch.column("leaves").slice(lo, hi - lo), by_leaf)

    def one_run(qcid, q, low, leaves, by_leaf) -> Iterator[pa.RecordBatch]:
        wanted, found = leaves.flatten().to_numpy(zero_copy_only=False), None
        asks = np.repeat(np.arange(len(qcid)), leaves.value_lengths().to_numpy(zero_copy_only=False))
        for one in np.unique(wanted).tolist():
            who, (ids, v) = asks[wanted == one], by_leaf.get(one, (np.zeros(0, np.int64), np.zeros((0, width))))
            for t in range(0, len(ids), vectors.STEP):
                i, c = _reaching(q[who], qcid[who], low[who], v[t : t + vectors.STEP], ids[t : t + vectors.STEP], k)
                if len(i):
                    new = (who[i], vectors.exact(q[who[i]], v[t + c]), ids[t + c])
                    found = vectors.best(*(new if found is None else (np.concatenate(x) for x in zip(found, new, strict=True))), k)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(qcid[found[0]]), pa.array(found[2]), pa.array(found[1])], names=["qcid", "cid", "score"])

    none = F.array().cast("array<bigint>")
    held = members.select("cell", F.lit(0).alias("kind"), "leaf", F.col("cid").alias("id"), "vec", none.alias("leaves"), F.lit(0.0).alias("low"))
    passing = asked.select("cell", F.lit(1).alias("kind"), F.lit(-1).cast("bigint").alias("leaf"), F.col("qcid").alias("id"), "vec", "leaves", "low")
    dealt = held.unionByName(passing).repartition("cell").sortWithinPartitions("cell", "kind", "leaf")
    return dealt.mapInArrow(run, "qcid bigint, cid bigint, score double")


def _dealt(index: DataFrame, asked: DataFrame, tree, sizes: np.ndarray, looks: int, width: int, k: int) -> list[DataFrame]:
    """(qcid, cid, score) of any number of queries (cid, vec), each dealt to the cells that it visits."""
    leaf_cells = cells(sizes, max(vectors.STEP, CELL_BYTES // (8 * max(1, width))))
    start = F.array(*[F.lit(c) for c, _ in leaf_cells]).cast("array<bigint>")
    own = F.array(*[F.lit(n) for _, n in leaf_cells]).cast("array<bigint>")
    leaf = F.col("leaf").cast("int")
    members = index.withColumn("cell", F.get(start, leaf) + F.pmod(F.xxhash64("cid"), F.get(own, leaf)))
    visits = _looks(asked, tree, leaf_cells, looks, sizes, k + 1, width)
    near = cut(_met(members, visits.filter("early").withColumn("low", F.lit(float("-inf"))), width, k))
    low = F.coalesce("low", F.lit(float("-inf")))
    wide = _met(members, visits.filter("not early").join(_kth(near, k), "qcid", "left").withColumn("low", low), width, k)
    return [near, wide]


def calibrate(index: DataFrame, tree: Tree, width: int, k: int, probes: int = PROBES, target: float = TARGET) -> int:
    """Leaf visits that find ``target`` of the k nearest of the sample queries, on average."""
    spark = index.sparkSession
    own = _block(spark, index.orderBy(F.xxhash64(F.lit("probe"), "vec"), "vec").limit(probes), width)
    if not len(own.cid):
        return 1
    promise, said = tree.promises(own.vec), spark.sparkContext.broadcast(own)
    bins = [tree.best_bins(p, tree.leaves) for p in promise]
    first = spark.sparkContext.broadcast(_visitors(bins, 0, max(1, tree.leaves // 32)))
    low = spark.sparkContext.broadcast(_bounds(_nearest(index, said, first, None, width, k), own, k))
    truth = _nearest(index, said, None, low, width, k)
    top = truth.groupBy("qcid").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("score"), "cid", "leaf"))), 1, k).leaf.alias("leaves")).collect()
    place = {int(c): i for i, c in enumerate(own.cid)}
    found = np.zeros(tree.leaves)
    for qcid, leaves in top:
        rank = {leaf: i for i, leaf in enumerate(bins[place[qcid]])}
        for leaf in leaves:
            found[rank[leaf]] += 1 / len(leaves)
    if not top:
        return 1
    share = np.cumsum(found) / len(top)
    return min(tree.leaves, int(np.argmax(share >= target - 1e-12)) + 1) if (share >= target - 1e-12).any() else tree.leaves


def search(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, target: float = TARGET, sample: int | None = None, block: int = vectors.BLOCK, visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product in doubles.

    Queries: rows whose vec_id is divisible by ``query_every``; candidates: every row but the
    query's own. Nearest first, ties to the smaller vec_id; scores are those of the original
    vectors. Fewer than k rows only where there are fewer candidates: where the calibrated visits
    hold too few vectors more leaves are visited. Vectors that are null, zero, empty or hold a null or
    non-finite component, and rows without vec_id, take no part; rows that share a
    vec_id are candidates each, but not for a query of that id, and answer as one query;
    shorter vectors count as padded with zeros. ``visits``
    overrides the calibrated number of leaves, ``sample`` the number of vectors that the tree
    is fitted on. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    kept = kept.filter(vectors.finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    rows = cut(kept.filter("vec_id is not null"))
    classes = cut(vectors.classes(rows, k))
    width, n = classes.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    width = width or 0
    large = n > DEEPER * BRANCH**DEPTH
    sample = sample or (max(SAMPLE, min(LARGE_SAMPLE, SAMPLE_BYTES // (8 * max(1, width)))) if large else SAMPLE)
    # the rows of smallest hash, told apart from most others before they are sorted
    few = F.pmod(F.xxhash64("vec"), F.lit(n)) < 2 * sample
    fitted = _block(spark, (classes.filter(few) if n > 2 * sample else classes).orderBy(F.xxhash64("vec"), "vec").limit(sample), width)
    tree = fit(fitted.vec, depth=DEPTH + large)
    shared = spark.sparkContext.broadcast(tree)
    salts = max(1, -(-n // (LEAF_ROWS * tree.leaves)))
    index = _assigned(classes, shared, width).repartition("leaf", F.pmod(F.xxhash64("cid"), F.lit(salts)))
    index = cut(index.sortWithinPartitions("leaf"))
    looks = visits or (tree.leaves if n <= k + 1 else calibrate(index, tree, width, k, target=target))

    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, members in index.groupBy("leaf").count().collect():  # a number for each leaf
        sizes[leaf] = members
    queries = cut(rows.filter(F.col("vec_id") % query_every == 0).join(classes.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")))
    asked = cut(queries.select(F.col("qcid").alias("cid")).distinct().join(index, "cid"))
    if asked.count() > block:
        found = _dealt(index, asked, shared, sizes, looks, width, k)
    else:
        own = _block(spark, asked, width)
        promise = tree.promises(own.vec) if len(own.cid) else np.zeros((0, len(tree.nodes)))
        bins = [tree.best_bins(p, looks, sizes, k + 1) for p in promise]
        first = max(1, looks // FIRST)
        said = spark.sparkContext.broadcast(own)
        near = cut(_nearest(index, said, spark.sparkContext.broadcast(_visitors(bins, 0, first)), None, width, k))
        low = spark.sparkContext.broadcast(_bounds(near, own, k))
        wide = _nearest(index, said, spark.sparkContext.broadcast(_visitors(bins, first, tree.leaves)), low, width, k)
        found = [near.drop("leaf"), wide.drop("leaf")]
    itself = asked.select(F.col("cid").alias("qcid"), "cid", "vec")
    every = reduce(DataFrame.unionByName, [*found, _itself(itself, width)])
    return vectors.answers(every, classes, queries, k)


def _itself(rows: DataFrame, width: int) -> DataFrame:
    """A query's own class, for its other rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, batch in vectors.batches_of(source, width):
            yield pa.RecordBatch.from_arrays([batch.column("qcid"), pa.array(ids), pa.array(vectors.exact(v, v))], names=["qcid", "cid", "score"])

    return rows.mapInArrow(run, "qcid bigint, cid bigint, score double")


def _visitors(bins: list[list[int]], start: int, stop: int) -> dict[int, np.ndarray]:
    """Per leaf the queries that look into it on their start-th to stop-th visit."""
    out: dict[int, list[int]] = {}
    for q, leaves in enumerate(bins):
        for leaf in leaves[start:stop]:
            out.setdefault(leaf, []).append(q)
    return {leaf: np.array(q) for leaf, q in out.items()}
