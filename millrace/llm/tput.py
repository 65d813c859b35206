"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of SLICES partial scores, one for each slice of the dimensions; each
(slice, chunk of vectors) is a node with its own list of partial scores for every query.

1. Each node sends the k entries of its highest partial scores. What was gathered is scored
   exactly; the k-th best of a query is its bound.
2. The bounds are broadcast; the cutoff is the bound divided by SLICES. A vector whose score
   reaches the bound has a partial score that reaches the cutoff in at least one slice, so
   every node sends the entries that do, and nothing can be missed.
3. The scores of what was sent and is not yet known are resolved exactly, from whole vectors.

Queries are broadcast in blocks of bounded size; the vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vectors
from millrace.llm.common import cut
from millrace.llm.vectors import Queries

K = 5
SLICES = 2
QUERY_EVERY = 50
SCALE = 256


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): floor(SCALE * x) of each component, for the rows that take part."""
    kept = embeddings.select("vec_id", F.col("embedding").alias("e")).filter(vectors.finite("e"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("e", lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"))


def _pairs(batch: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q, cid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*batch, strict=True)) if batch else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(cid.astype(np.int64))], names=["qcid", "cid"])


def _times(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of 64-bit integers, as doubles: exact below 2**53, to a part in 2**52 beyond."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return q.astype(np.float64) @ v.astype(np.float64).T
    return (q @ v.T).astype(np.float64)


def _parts(nodes: DataFrame, slices: int, width: int) -> list[tuple[int, int]]:
    cuts = [round(i * width / slices) for i in range(slices + 1)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo] or [(0, width)]


def _gather(nodes: DataFrame, block, parts: list[tuple[int, int]], width: int, k: int) -> DataFrame:
    """Phase 1: (qcid, cid) of the k highest partial scores of every node."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = block.value
        lists = {}
        for ids, v, batch in vectors.batches_of(source, width, "part", kind=np.int64):
            slices = batch.column("slice").to_numpy(zero_copy_only=False)
            for s in np.unique(slices).tolist():
                lo, hi = parts[s]
                at = np.flatnonzero(slices == s)
                scores = _times(own.vec[:, lo:hi], v[at, : hi - lo])
                scores = np.where(own.cid[:, None] == ids[at][None, :], -np.inf, scores)
                r, c = vectors.near_top(scores, k, 0)
                new = (r, scores[r, c], ids[at][c])
                new = tuple(np.concatenate(x) for x in zip(lists[s], new, strict=True)) if s in lists else new
                lists[s] = vectors.best(*new, k)
        yield _pairs([(own.cid[q], ids) for q, _, ids in lists.values()])

    return nodes.mapInArrow(run, "qcid bigint, cid bigint").distinct()


def _resolve(pairs: DataFrame, classes: DataFrame, block, width: int) -> DataFrame:
    """(qcid, cid, score): exact scores of pairs, from whole vectors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = block.value
        order = np.argsort(own.cid)
        for ids, v, batch in vectors.batches_of(source, width, kind=np.int64):
            qcid = batch.column("qcid").to_numpy(zero_copy_only=False)
            q = own.vec[order[np.searchsorted(own.cid, qcid, sorter=order)]]
            score = (q * v).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(qcid), pa.array(ids), pa.array(score)], names=["qcid", "cid", "score"])

    return pairs.join(classes.select("cid", "vec"), "cid").select("qcid", "cid", "vec").mapInArrow(run, "qcid bigint, cid bigint, score bigint")


def _collect(nodes: DataFrame, block, bounds, parts: list[tuple[int, int]], width: int) -> DataFrame:
    """Phase 2: (qcid, cid) of the partial scores that reach the uniform cutoff."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = block.value
        cutoff = np.array([bounds.value.get(c, -np.inf) for c in own.cid.tolist()], float) / len(parts)
        cutoff = cutoff - 1e-12 * np.where(np.isfinite(cutoff), np.abs(cutoff), 0)  # beyond 2**53 products are rounded
        for ids, v, batch in vectors.batches_of(source, width, "part", kind=np.int64):
            slices, sent = batch.column("slice").to_numpy(zero_copy_only=False), []
            for s in np.unique(slices).tolist():
                lo, hi = parts[s]
                at = np.flatnonzero(slices == s)
                q, c = np.nonzero(_times(own.vec[:, lo:hi], v[at, : hi - lo]) >= cutoff[:, None])
                sent.append((own.cid[q], ids[at][c]))
            yield _pairs(sent)

    return nodes.mapInArrow(run, "qcid bigint, cid bigint").distinct()


def search(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, slices: int = SLICES, block: int = vectors.BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Queries: rows whose vec_id is divisible by ``query_every``; candidates: every row but the
    query's own; all of them if there are fewer than k. Ties go to the smaller vec_id. Vectors
    that are null or hold a null or non-finite component, and rows without vec_id, take no
    part; rows that share a vec_id are candidates each, but not for a query of that id, and
    answer as one query; shorter vectors count as padded with zeros. Scores are 64-bit
    integers. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = cut(integers(embeddings).filter("vec_id is not null"))
    classes = cut(vectors.classes(rows, k))
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 0
    queries = cut(rows.filter(F.col("vec_id") % query_every == 0).join(classes.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")))
    asked = cut(queries.select(F.col("qcid").alias("cid")).distinct().join(classes, "cid").select("cid", "vec"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    parts = _parts(classes, slices, width)
    pieces = F.array(*[F.struct(F.lit(s).alias("slice"), F.slice("vec", lo + 1, max(1, hi - lo)).alias("part")) for s, (lo, hi) in enumerate(parts)])
    nodes = cut(classes.select("cid", F.inline(pieces)))

    found = []
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == i).toArrow()  # about ``block`` rows
        own = spark.sparkContext.broadcast(Queries(mine["cid"].to_numpy(), vectors.matrix(mine["vec"], width, np.int64) if mine.num_rows else np.zeros((0, width), np.int64)))
        known = cut(_resolve(_gather(nodes, own, parts, width, k).filter("qcid <> cid"), classes, own, width))
        ranked = known.groupBy("qcid").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth")).filter("size(kth) = 1")
        bounds = spark.sparkContext.broadcast({q: b[0] for q, b in ranked.collect()})  # a number for each query of the block
        sent = _collect(nodes, own, bounds, parts, width)
        rest = _resolve(sent.join(known.select("qcid", "cid"), ["qcid", "cid"], "left_anti"), classes, own, width)
        itself = _resolve(asked.filter(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == i).select(F.col("cid").alias("qcid"), "cid"), classes, own, width)
        found.append(known.unionByName(rest).unionByName(itself))
    every = reduce(DataFrame.unionByName, found).distinct()
    return vectors.answers(every, classes, queries, k).select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))


#: DuckDB: every query against every row.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
