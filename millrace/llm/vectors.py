"""What the two vector searches share.

Equal vectors are searched as one class: a result of k rows for a query can only use k rows
of an id and, as its own id is left out, the 2 * k smallest rows of a class, so a class keeps
those, and a vector that a third of all rows have is one row. Queries are classes too; their
answers are handed back to each of their rows at the end. Rows that share a vec_id are
candidates each; none of them is a candidate of a query with that id, and as queries
they share one answer of k rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of vectors multiplied at a time.
STEP = 2048
#: Query classes broadcast at a time.
BLOCK = 4096


def finite(vector: str) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    x = F.col(vector)
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, vec, ids): the classes of rows (vec_id, vec), numbered, with their 2 * k smallest ids, of which none k times over."""
    # counted before the shuffle by vector: an id's repeats are one row of it
    own = rows.groupBy("vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = own.withColumn("place", place).filter(F.col("place") <= 2 * k)
    ids = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "times"))), lambda x: F.array_repeat(x["vec_id"], x["times"]))), 1, 2 * k)
    return few.groupBy("vec").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("cid"), "vec", "ids")


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of numbers, padded with zeros (or cut) to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width), kind), 0
    for i, n in enumerate(sizes.tolist()):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


@dataclass
class Queries:
    """A block of query classes."""

    cid: np.ndarray
    vec: np.ndarray


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per q the k entries of highest score, ties to smaller ids."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = order[place < k]
    return (q[place < k], score[keep], ids[keep], *[m[keep] for m in more])


def near_top(scores: np.ndarray, k: int, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of every entry that may be among its row's k highest."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= (edge - slack * (1 + np.abs(edge)))[:, None])


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal sums wherever they stand."""
    return np.ascontiguousarray(q * v).sum(axis=1)


def answers(found: DataFrame, classes_: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of class pairs (qcid, cid, score) for query rows (query_id, qcid)."""
    each = found.join(classes_.select("cid", "ids"), "cid").select("qcid", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    few = each.withColumn("place", F.row_number().over(Window.partitionBy("qcid").orderBy(*order))).filter(F.col("place") <= 2 * k)
    own = queries.join(few.drop("place"), "qcid").filter("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def batches_of(source: Iterator[pa.RecordBatch], width: int, vec: str = "vec", cid: str = "cid", kind=np.float64) -> Iterator[tuple]:
    """(ids, matrix, batch) of at most STEP rows."""
    for b in source:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            yield part.column(cid).to_numpy(zero_copy_only=False), matrix(part.column(vec), width, kind), part
