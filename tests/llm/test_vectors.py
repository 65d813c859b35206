import math
import random

import duckdb
import numpy as np
import pytest

from millrace.llm import ann, tput, vectors
from tests.llm.fixtures import CLASH, rows_of
from pyspark.sql import functions as F

ROWS = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], ROWS).repartition(3).withColumns({c: F.lit(c) for c in CLASH})


def vectors_of(n, dim=16, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # a third of all rows are alike
    return [(i, np.array(v, np.float32).tolist()) for i, v in rows]


ODD = [(9000, None), (9020, [float("nan")] * 16), (9040, [float("inf")] + [0.0] * 15), (9060, [0.0] * 16), (None, [1.0] * 16), (9100, [None] + [1.0] * 15), (9120, [])]


def brute(rows, every, k, ok, score):
    kept = {i: v for i, v in rows if i is not None and ok(v)}
    out = []
    for q in sorted(kept):
        if q % every == 0:
            best = sorted((-score(kept[q], v), i) for i, v in kept.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v):
    return [math.floor(256 * x) for x in v]


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_exact_search(spark, slices):
    rows = vectors_of(400) + ODD
    got = sorted(rows_of(tput.search(table(spark, rows), slices=slices)))
    assert got == brute(rows, 50, 5, whole, lambda a, b: dot(ints(a), ints(b)))


def test_exact_search_in_blocks(spark):
    rows = vectors_of(300, 4)
    assert sorted(rows_of(tput.search(table(spark, rows), query_every=3, block=16))) == brute(rows, 3, 5, whole, lambda a, b: dot(ints(a), ints(b)))


def test_exact_search_small_tables(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [-1.0, 0.0]), (51, [-1.0, 0.0])]
    assert sorted(rows_of(tput.search(table(spark, rows)))) == [(0, 1, 50, 327680), (0, 2, 51, -65536), (0, 3, 51, -65536), (50, 1, 0, 327680), (50, 2, 51, -65536), (50, 3, 51, -65536)]
    assert [r[:3] for r in sorted(rows_of(ann.search(table(spark, rows), query_every=50)))] == [(0, 1, 50), (0, 2, 51), (0, 3, 51), (50, 1, 0), (50, 2, 51), (50, 3, 51)]
    assert rows_of(tput.search(table(spark, rows[:1]))) == []
    assert rows_of(tput.search(table(spark, rows).limit(0))) == []
    large = [(0, [1e8, 1.0]), (1, [1e6, 2.0]), (2, [3.0, 4.0])]
    assert sorted(rows_of(tput.search(table(spark, large))))[0][2] == 1


def test_sql_agrees_on_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30) * 10, [float(rng.randrange(-3, 4)) for _ in range(4)]) for _ in range(150)] + [(50, [1.0] * 4)] * 12 + [(51, [2.0] * 4)] * 9
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(tput.SQL).fetchall()) == sorted(rows_of(tput.search(table(spark, rows))))


def test_few_classes_over_many_partitions(spark):
    """Huge groups of copies: fewer classes in a partition than neighbours asked for, the query's own among them."""
    rng = random.Random(8)
    kinds = [[float(rng.randrange(-9, 10)) for _ in range(6)] for _ in range(9)]
    rows = [(i, kinds[i % 9] if i % 4 else kinds[0]) for i in range(200)]
    assert sorted(rows_of(tput.search(table(spark, rows).repartition(40)))) == brute(rows, 50, 5, whole, lambda a, b: dot(ints(a), ints(b)))


def test_products_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**21 + 1, 1.0]), (1, [2.0**21 + 3, 5.0]), (2, [2.0**21 + 3, 3.0]), (3, [2.0**21 + 3, 4.0])]
    assert sorted(rows_of(tput.search(table(spark, rows)))) == brute(rows, 50, 5, whole, lambda a, b: dot(ints(a), ints(b)))


def test_an_outlier_still_gets_k(spark):
    """Most vectors lie in tight groups, so few leaves are visited; a query in a thin leaf goes on."""
    rng = random.Random(6)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(2 * i + 1, [x + rng.gauss(0, 0.01) for x in centers[i % 20]]) for i in range(1500)] + [(20 * i, [rng.gauss(0, 30) for _ in range(8)]) for i in range(10)]
    got = rows_of(ann.search(table(spark, rows), visits=1))
    assert len(got) == 10 * 20


def test_whole_tree_is_exact(spark):
    rows = vectors_of(500) + ODD
    n = 10**6
    got = sorted(rows_of(ann.search(table(spark, rows), visits=n)))
    want = brute(rows, 20, 20, lambda v: whole(v) and any(v), dot)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want, strict=True)) < 1e-9


@pytest.mark.parametrize("cell_rows", [30, 10**6])
def test_dealt_queries_are_exact_and_find_what_broadcast_ones_do(spark, monkeypatch, cell_rows):
    """More queries than a block: leaves shared by a cell, split over cells, and a third of all rows alike."""
    monkeypatch.setattr(vectors, "STEP", 64)
    monkeypatch.setattr(ann, "CELL_BYTES", 8 * 16 * cell_rows)
    rows = vectors_of(900) + ODD
    whole_tree = sorted(rows_of(ann.search(table(spark, rows), visits=10**6, block=4)))
    want = brute(rows, 20, 20, lambda v: whole(v) and any(v), dot)
    assert [r[:3] for r in whole_tree] == [r[:3] for r in want]
    some = [sorted(rows_of(ann.search(table(spark, rows), visits=5, block=b))) for b in (4, 4096)]
    assert some[0] == some[1]


def test_cells_hold_every_leaf_and_are_bounded():
    sizes = np.array([3, 4, 0, 25, 2, 10, 1, 9, 10, 0])
    told = ann.cells(sizes, 10)
    assert told == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (5, 1), (6, 1), (6, 1), (7, 1), (7, 1)]


def test_a_larger_table_has_a_deeper_tree(spark, monkeypatch):
    monkeypatch.setattr(ann, "DEEPER", 2)
    monkeypatch.setattr(ann, "SAMPLE", 600)
    rows = vectors_of(3000, 8)
    got, want = rows_of(ann.search(table(spark, rows))), brute(rows, 20, 20, whole, dot)
    assert len(got) == len(want)
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)


def test_recall(spark):
    rows = vectors_of(3000, 24)
    got = rows_of(ann.search(table(spark, rows)))
    want = brute(rows, 20, 20, whole, dot)
    assert len(got) == len(want)
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)


def test_ann_small_tables(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (21, [0.0, 0.5]), (22, [0.0, 0.0])]
    assert sorted(rows_of(ann.search(table(spark, rows)))) == [(0, 1, 20, 5.0), (0, 2, 21, 1.0), (20, 1, 0, 5.0), (20, 2, 21, 1.0)]
    assert rows_of(ann.search(table(spark, rows[:1]))) == []
    assert rows_of(ann.search(table(spark, rows).limit(0))) == []


def test_best_bins_come_first():
    rng = np.random.default_rng(1)
    tree = ann.fit(rng.normal(size=(1000, 8)), branch=4, depth=2)
    promise = tree.promises(rng.normal(size=(1, 8)))[0]
    order = tree.best_bins(promise, tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.best_bins(promise, 3) == order[:3]
    top = max(tree.nodes[0].children, key=lambda c: promise[c])
    assert order[0] in [tree.nodes[c].leaf for c in (tree.nodes[top].children or [top])] or max(promise[c] for c in tree.nodes[top].children) < max(promise)


def test_equal_rows_give_equal_sums():
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=64), rng.normal(size=64)
    sums = [vectors.exact(np.tile(q, (n, 1)), np.tile(v, (n, 1))) for n in (1, 3, 8, 77)]
    assert len({x for s in sums for x in s.tolist()}) == 1
