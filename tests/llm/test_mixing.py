from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing
from millrace.scratch import shared_folder
from tests.llm.fixtures import documents, frame, rows_of


def size_of(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_targets(sizes, budget=1.5, cap=2):
    """Water filling by bisection."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = budget * sum(sizes.values())
    lo, hi = 0.0, 10.0 * (1 + sum(sizes.values()))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(min(cap * sizes[s], weight[s] * mid) for s in sizes) > total else (mid, hi)
    return {s: min(cap * sizes[s], weight[s] * lo) for s in sizes}


def plain_sainte_lague(weights, seats):
    quota = {k: 0 for k in weights}
    for _ in range(seats):
        best = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * quota[k] + 1), k))
        quota[best] += 1
    return quota


def test_against_plain_arithmetic(spark):
    rows = documents()
    got = rows_of(mixing.mix(frame(spark, rows, clash=True)).select("doc_id", "size", "source_size", "target", "taken"))
    assert len(got) == len(rows)
    sources, sizes, taken = {r[0]: r[3] for r in rows}, defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    want = plain_targets(dict(sizes))
    for doc_id, size, source_size, target, n in got:
        assert size == size_of(dict((r[0], r[1]) for r in rows)[doc_id]) and 0 <= n <= 2 * size
        assert source_size == sizes[sources[doc_id]] and abs(target - want[sources[doc_id]]) < 1e-6 * max(1, target)
        taken[sources[doc_id]] += n
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 1


def test_small_shards_and_reruns(spark):
    rows = documents(200)
    one = sorted(rows_of(mixing.mix(frame(spark, rows), shard_rows=7)), key=repr)
    assert one == sorted(rows_of(mixing.mix(frame(spark, rows).repartition(5), shard_rows=7)), key=repr)
    sources, target, taken = {r[0]: r[3] for r in rows}, {}, defaultdict(int)
    for doc_id, size, _, t, n, _ in one:
        assert n <= 2 * size
        target[sources[doc_id]] = t
        taken[sources[doc_id]] += n
    assert all(abs(taken[s] - t) <= 0.03 * t + 8 for s, t in target.items())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(0, 70))
def test_quotas(spark, weights, seats):
    rows = [(f"k{i}", float(w), seats) for i, w in enumerate(weights)]
    got = rows_of(mixing.sainte_lague(spark.createDataFrame(rows, "key string, weight double, seats bigint"), [], ["key"], "weight", "seats").select("key", "quota"))
    if sum(weights):
        quota = dict(got)
        want = plain_sainte_lague({k: w for k, w, _ in rows}, seats)
        assert sum(quota.values()) == seats
        assert quota == want


def test_sources_are_met_either_way(spark):
    """Broadcast or shuffled, a row has its source's columns; a null source is a source."""
    rows = [(i, s) for i, s in enumerate(["a"] * 9 + [None] * 4 + ["b"] * 2 + ["c"])]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string")
    sources = spark.createDataFrame([("a", 9, 1.0), (None, 4, 2.0), ("b", 2, 3.0), ("c", 1, 4.0)], "source string, rows bigint, target double")
    want = sorted((i, s, {"a": 1.0, None: 2.0, "b": 3.0, "c": 4.0}[s]) for i, s in rows)
    for large in (1, 2, 5, 50_000):
        out = mixing.with_source(sized, sources, large)
        assert out.columns == ["doc_id", "source", "target"]
        assert sorted(rows_of(out)) == want
    assert rows_of(mixing.with_source(sized.limit(0), sources.limit(0))) == []


def test_nulls_repeats_empty(spark):
    rows = [(1, "a b c", None, None, 1), (1, "a b c", None, None, 1), (None, None, None, "s", None), (3, "", None, "s", 0)]
    got = rows_of(mixing.mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken"))
    assert sorted((r[1], r[2]) for r in got) == [(0, 0), (0, 0), (3, 6), (3, 6)]
    assert all(r[4] <= 2 * r[1] for r in got) and sum(r[4] for r in got) == 9
    assert rows_of(mixing.mix(frame(spark, []))) == []
    assert {r[4] for r in rows_of(mixing.mix(frame(spark, rows[2:])))} == {0}


def test_mixed_rows_have_the_words_taken(spark):
    rows = [r for r in documents() if r[1] is not None]
    df = frame(spark, rows)
    taken = {r[0]: r[4] for r in rows_of(mixing.mix(df))}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for doc_id, text, _, _, n_chars in rows_of(out):
        words[doc_id] += size_of(text)
        assert n_chars == len(text)
    assert words == {k: v for k, v in taken.items() if v}


def test_small_tables_are_few_files(spark):
    """However many shuffle partitions there are, the tables of sources and shards are a file each, and no other has more than a few a core."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "90")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = Path(urlparse(shared_folder(session)).path)
    before = set(folder.rglob("part-*"))
    rows = documents()
    mixed = mixing.mix(frame(session, rows).repartition(70), shard_rows=10)
    files = set(folder.rglob("part-*")) - before
    most = 8 * session.sparkContext.defaultParallelism
    assert len(files) <= most + 4 and mixed.rdd.getNumPartitions() <= most
    assert sorted(map(str, rows_of(mixed))) == sorted(map(str, rows_of(mixing.mix(frame(spark, rows), shard_rows=10))))
