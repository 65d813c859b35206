"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row of the table holds its Hamming distances to PIVOTS reference
fingerprints, kept apart by six bands of its bits (a distance is the sum over the bands).
Two fingerprints that differ in at most four bits differ nowhere in at least two bands, so
there their coordinates have a maximum difference of zero: equal coordinates of two bands
are the join key, and no pair is lost. Of the pairs that meet, those whose distances to
any pivot differ by more than four are discarded (the triangle inequality), and the Hamming
distance decides on the rest.

Equal fingerprints are one class from the start. In a cell of up to SMALL classes all pairs
are tried; in a larger one a search scans, for each class found, only the classes not yet
reached, so that a dense cell costs little and yields a spanning tree instead of all its
pairs. Cells above CELL classes are split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, split_by
from millrace.llm.components import connected_components

BITS = 64
MAX_DISTANCE = 4
BANDS = 6
PIVOTS = 16
SMALL = 8
CELL = 4096
#: Shingles hashed at a time, so that memory does not grow with a text.
STEP = 1 << 16
SHINGLE = 4
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the lower-cased (A-Z) words' shingles, repeats included; 0 without a word."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP):
        part = words[at : min(at + STEP, total) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[min(shingle, len(part)) - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=False)), np.uint64, len(stops))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64 bits as a BIGINT."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)


def band_masks() -> list[int]:
    cuts = [round(i * BITS / BANDS) for i in range(BANDS + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def distance_table(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates packed by band, four bits a pivot (n x BANDS), and whole distances (n x PIVOTS)."""
    apart = fps[:, None] ^ pivots()[None, :]
    packed, whole = np.zeros((len(fps), BANDS), np.uint64), np.zeros((len(fps), PIVOTS), np.int16)
    lanes = np.arange(PIVOTS, dtype=np.uint64) * np.uint64(4)
    for i, mask in enumerate(band_masks()):
        part = np.bitwise_count(apart & np.uint64(mask))
        whole += part
        packed[:, i] = (part.astype(np.uint64) << lanes).sum(axis=1, dtype=np.uint64)
    return packed, whole


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of bands a key of their coordinates. Keys that collide only add a pair to verify."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        packed, _ = distance_table(fps)
        keys = []
        for n, (i, j) in enumerate(combinations(range(BANDS), 2)):
            k = (packed[:, i] + np.uint64(n + 1)) * mix
            k = ((k ^ (k >> np.uint64(31))) + packed[:, j]) * mix
            keys.append((k ^ (k >> np.uint64(29))).view(np.int64))
        times = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.tile(fps.view(np.int64), times)), pa.array(np.tile(b.column("rep").to_numpy(zero_copy_only=False), times))],
            names=["key", "fp", "rep"],
        )


def _near(fps: np.ndarray, whole: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Of the rows ``among``, those within MAX_DISTANCE of row i: by the table first, then exactly."""
    for p in range(PIVOTS):
        among = among[np.abs(whole[among, p] - whole[i, p]) <= MAX_DISTANCE]
        if len(among) < 64:
            break
    among = among[np.abs(whole[among] - whole[i]).max(axis=1, initial=0) <= MAX_DISTANCE]
    return among[np.bitwise_count(fps[among] ^ fps[i]) <= MAX_DISTANCE]


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever links within MAX_DISTANCE connect."""
    _, whole = distance_table(fps)
    rest, edges = np.arange(len(fps)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            found = _near(fps, whole, i, rest)
            if len(found):
                edges += [(i, int(j)) for j in found]
                todo += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; the rows of the last cell of a batch wait for the next batch."""

    def edges_of(cell: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(cell):
            return
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        a, b = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for step in range(1, SMALL):
            i = np.flatnonzero(small[:-step] & (cell[step:] == cell[:-step])) if len(cell) > step else np.empty(0, int)
            if not len(i):
                break
            j = i + step
            _, left = distance_table(fps[i])
            _, right = distance_table(fps[j])
            keep = (np.abs(left - right).max(axis=1, initial=0) <= MAX_DISTANCE) & (np.bitwise_count(fps[i] ^ fps[j]) <= MAX_DISTANCE)
            a.append(reps[i[keep]])
            b.append(reps[j[keep]])
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own, at = np.unique(fps[s : s + n], return_index=True)
            pairs = np.array(spanning(own), int).reshape(-1, 2)
            names = reps[s : s + n][at]
            a.append(names[pairs[:, 0]])
            b.append(names[pairs[:, 1]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "rep")]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
        yield from edges_of(now[0][:last], now[1][:last].view(np.uint64), now[2][:last])
        held = [x[last:] for x in now]
    if held is not None:
        yield from edges_of(held[0], held[1].view(np.uint64), held[2])


def links(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between the ``rep`` of classes (fp, rep) that connect what lies within MAX_DISTANCE bits."""
    rows = classes.mapInArrow(_keys, "key bigint, fp bigint, rep bigint")
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(crowded, "key").withColumn("chunks", F.ceil(F.col("n") / F.lit(cell)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "rep")
    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, more).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links of
    at most four differing bits reach, the document itself included. A null or empty text,
    or one without words, has fingerprint zero and links like any other. Rows that repeat a
    doc_id are kept, each with its own text's fingerprint. A row without doc_id gets the
    component of the documents with its fingerprint, null if there are none. Other columns
    are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    found = connected_components(links(classes))
    named = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, whose doc_id is the smallest of its component.

    Rows without doc_id go; of rows that share one, that of the least text stays. Only rows
    that may go are shuffled.
    """
    near = near_duplicates(docs).filter("doc_id is not null")
    each = cut(near.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count(F.lit(1)).alias("rows")))
    gone = each.filter("not kept").select(F.col("doc_id").alias("gone_id"))
    apart, met = split_by(docs.filter("doc_id is not null"), "doc_id", gone, "gone_id")
    out = apart.unionByName(met.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"))
    if each.filter("kept and rows > 1").isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place.alias("place"))
    return rows.filter("place = 1").select("row.*")
