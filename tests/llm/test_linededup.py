import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import linededup
from tests.llm.fixtures import documents, frame, rows_of, words

LONG = " ".join(str(i * i) for i in range(12_000))
ASCII_SPACE = " \t\n\v\f\r"


def shingles(line, n=linededup.SHINGLE):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def blank(line):
    return not line.strip(ASCII_SPACE)


def plain_groups(rows):
    """First place of each line's component, by comparing all pairs of distinct lines."""
    places = defaultdict(list)
    for r in rows:
        for i, line in enumerate(r[1].split("\n") if r[1] is not None else []):
            if not blank(line):
                places[line].append((r[0], i))
    distinct, sets = sorted(places), {}
    for line in distinct:
        sets[line] = shingles(line)
    up = {x: x for x in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                up[root(a)] = root(b)
    first = {}
    for line in distinct:
        first[root(line)] = min(first.get(root(line), (1 << 60, 0)), min(places[line]))
    return {p: first[root(line)] for line in distinct for p in places[line]}


def edited(rng, line, n):
    parts = line.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = "x" + str(rng.randrange(9))
    return " ".join(parts)


def test_brute_force(spark):
    rng, rows = random.Random(5), documents(60)
    base = [" ".join(words(rng, "en", 60)) for _ in range(12)]
    rows += [(1000 + i, "\n".join([edited(rng, rng.choice(base), rng.randint(0, 3)), "alone " + str(rng.random())]), "en", "a", None) for i in range(80)]
    got = {(d, p): (fd, fp) for d, p, _, fd, fp in rows_of(linededup.line_groups(frame(spark, rows, clash=True)))}
    want = plain_groups(rows)
    assert all(got[p] == p for p in got if p not in want)
    assert set(want) <= set(got)
    # banding is a draw: what it links must be right, and it must link nearly everything
    assert sum(got[p] == want[p] for p in want) >= 0.98 * len(want)
    assert all(kept == ((d, p) == (fd, fp)) for d, p, kept, fd, fp in rows_of(linededup.line_groups(frame(spark, rows))))


def test_large_bucket_loses_no_link(spark):
    """Many variants of one line, and of another that shares most of its bands."""
    rng = random.Random(7)
    base = " ".join(words(rng, "en", 80))
    other = base[: len(base) // 2] + " ".join(words(rng, "fr", 40))
    rows = [(i, edited(rng, base if i % 2 else other, 2), None, None, None) for i in range(120)]
    got = {d: fd for d, _, _, fd, _ in rows_of(linededup.line_groups(frame(spark, rows)))}
    want = {p[0]: f[0] for p, f in plain_groups(rows).items()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_odd_lines(spark):
    rows = [
        (1, "a\n\n \na\nb", None, None, 8), (2, "a", None, None, 1), (2, "a", None, None, 1), (3, None, None, None, None), (4, "", None, None, 0),
        (None, "a", None, None, 1), (5, LONG, None, None, len(LONG)), (6, LONG + " end", None, None, len(LONG) + 4), (7, "日本語の長い行です。" * 20, None, None, 200), (8, "日本語の長い行です。" * 20 + "終", None, None, 201),
    ]
    got = sorted(rows_of(linededup.line_groups(frame(spark, rows))))
    assert [r for r in got if r[0] == 1] == [(1, 0, True, 1, 0), (1, 1, True, 1, 1), (1, 2, True, 1, 2), (1, 3, False, 1, 0), (1, 4, True, 1, 4)]
    assert [r for r in got if r[0] == 2] == [(2, 0, False, 1, 0)] * 2
    assert [r for r in got if r[0] == 4] == [(4, 0, True, 4, 0)]
    assert not [r for r in got if r[0] in (None, 3)]
    assert [r[3] for r in got if r[0] in (5, 6, 7, 8)] == [5, 5, 7, 7]
    assert rows_of(linededup.line_groups(frame(spark, []))) == []


def test_documents_lose_the_lines(spark):
    rows = [(1, "one line here\nanother one", "en", "s", 25), (2, "one line here\nnew text now", "en", "s", 26), (3, "another one", "en", "s", 11), (4, "", "en", "s", 0), (5, None, None, None, None), (6, "x\n\nx", "en", "s", 4)]
    out = linededup.dedup_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(rows_of(out)) == [(1, "one line here\nanother one", "en", "s", 25), (2, "new text now", "en", "s", 12), (4, "", "en", "s", 0), (5, None, None, None, None), (6, "x\n", "en", "s", 2)]


def test_rows_without_or_with_a_shared_id(spark):
    rows = [(None, "a line\nb line", None, None, 13), (1, "a line\nb line", None, None, 13), (1, "c line\nb line", None, None, 13), (2, "b line\nd line", None, None, 13)]
    got = sorted(rows_of(linededup.dedup_lines(frame(spark, rows)).select("doc_id", "text")), key=repr)
    assert got == sorted([(None, "a line\nb line"), (1, "a line\nb line"), (1, "c line\nb line"), (2, "d line")], key=repr)


def test_lines_of_few_words_stay_apart(spark):
    alike = ["https://example.org/a", "https://python.net/zz", "https://x.y/login", "2024-01-01T00:00:01", "2024-01-31T23:59:59", "internationalization", "internationalism"]
    alike += ["photosynthesis", "photosynthetic", "Donaudampfschifffahrt", "Donaudampfmaschine", "abcdefgh-1111-2222-333", "abcdefgh-9999-0000-aaa"]
    got = rows_of(linededup.line_groups(frame(spark, [(i, line, None, None, None) for i, line in enumerate(alike)])))
    assert all(kept for _, _, kept, _, _ in got) and len(got) == len(alike)


def test_lines_that_share_one_hash_stay_apart(spark, monkeypatch):
    """Buckets carry one hash only; where it collides the texts decide."""
    monkeypatch.setattr(linededup, "name", lambda line: [F.lit(7).cast("bigint").alias("id"), F.xxhash64(line).alias("more")])
    texts = ["the first line of a text", "something else altogether", "the first line of a text!", "the first line of a text"]
    got = rows_of(linededup.line_groups(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])))
    assert {d: first for d, _, _, first, _ in got} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_no_python_in_the_plan(spark):
    plan = linededup.signatures(linededup.lines(frame(spark, documents(20))).select(*linededup.name(F.col("line")), "line"), 8)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Python" not in plan and "Arrow" not in plan
