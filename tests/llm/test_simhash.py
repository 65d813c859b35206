from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.components import connected_components
from tests.llm.fixtures import documents, frame, rows_of


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(prints):
    ids, out = sorted(prints), {}
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= 4] for i in ids}
    for i in ids:
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def test_brute_force(spark):
    rows = documents()
    got = {r[0]: (r[1], r[2]) for r in rows_of(simhash.near_duplicates(frame(spark, rows, clash=True)))}
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert {i: int(x, 16) for i, (x, _) in got.items()} == prints
    assert all(len(x) == 16 for x, _ in got.values())
    assert {i: c for i, (_, c) in got.items()} == components(prints)


def test_spark_hash_agrees(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_repeats_nulls_empty(spark):
    rows = [(1, "a b", None, None, 1), (1, "a b", None, None, 1), (2, "a b", None, None, 1), (None, "a b", None, None, 1), (None, "alone here", None, None, 1)]
    got = Counter(rows_of(simhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id")))
    assert got == Counter([(1, 1), (1, 1), (2, 1), (None, 1), (None, None)])
    assert rows_of(simhash.near_duplicates(frame(spark, []))) == []


def test_cells_are_split(spark):
    """With tiny cells every cell is cut into pairs of chunks; nothing is lost."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)})
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(prints)], "fp bigint, rep bigint")
    want = components(dict(enumerate(prints)))
    for cell in (16, 4096):
        found = dict(rows_of(connected_components(simhash.links(table, cell=cell))))
        assert {i: found.get(i, i) for i in want} == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 2**64 - 1))
def test_pivots_never_discard_a_link(xs, flip):
    fps = np.array([*xs, *[x ^ (1 << flip % 64) ^ (1 << flip % 61) for x in xs]], np.uint64)
    _, whole = simhash.distance_table(fps)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    worst = np.abs(whole[:, None, :] - whole[None, :, :]).max(axis=2)
    assert (worst <= apart).all()


def test_one_stays(spark):
    rows = documents()
    kept = simhash.first_of_group(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r[0] for r in rows_of(kept)) == sorted({c for c in components({r[0]: plain_fingerprint(r[1]) for r in rows}).values()})
    twice = frame(spark, [(1, "b", None, None, 1), (1, "a", None, None, 1), (1, "a", None, None, 1)])
    assert [r[:2] for r in rows_of(simhash.first_of_group(twice))] == [(1, "a")]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_components_spread_out(spark, monkeypatch):
    from millrace.llm import components as c

    monkeypatch.setattr(c, "ONE_TASK", 0)
    edges = [(i, i + 1) for i in range(40)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {i: 0 for i in range(41)}
