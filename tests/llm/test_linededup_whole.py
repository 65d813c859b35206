"""Line dedup against the Jaccard similarity of all character shingles."""

import random
from collections import defaultdict

from millrace.llm import linededup
from tests.llm.fixtures import frame, rows_of, words


def shingles(line, n=linededup.SHINGLE):
    return {line[i : i + n] for i in range(len(line) - n + 1)} if len(line) >= n else {line}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def groups(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {d: first for d, _, _, first, _ in rows_of(linededup.line_groups(frame(spark, rows)))}


def edited(rng, line, n):
    parts = line.split(" ")
    for i in rng.sample(range(len(parts)), n):
        parts[i] = "x" + str(rng.randrange(99))
    return " ".join(parts)


def plain_groups(texts):
    """The least index of each text's component, by comparing all pairs."""
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and jaccard(texts[i], texts[j]) >= linededup.SIMILARITY:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(len(texts))}


def test_one_word_lines_stay(spark):
    texts = ["2024-01-15T10:22:33Z", "2024-01-20T08:00:00Z", "https://a.org/x", "https://b.net/y", "abcdefgh-first", "abcdefgh-second", "ab", "abc"]
    assert groups(spark, texts) == {i: i for i in range(len(texts))}


def test_families_by_all_shingles(spark):
    rng = random.Random(11)
    base = [" ".join(words(rng, "en", 50)) for _ in range(6)]
    texts = [edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(90)]
    got, want = groups(spark, texts), plain_groups(texts)
    together = defaultdict(set)
    for i in want:
        together[got[i]].add(want[i])
    assert all(len(x) == 1 for x in together.values())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_every_pair_of_a_crowded_bucket_meets(spark, monkeypatch):
    """Twenty similar pairs in one bucket of several chunks, most of them unlike its first lines."""
    monkeypatch.setattr(linededup, "bands", lambda: [[]])  # one bucket of all lines
    monkeypatch.setattr(linededup, "CHUNK", 4, raising=False)
    rng = random.Random(2)
    texts = [" ".join(words(rng, "en", 30)) for _ in range(20)]
    texts += [edited(rng, t, 1) for t in texts]
    want = plain_groups(texts)
    assert sum(want[i] != i for i in want) >= 15
    assert groups(spark, texts) == want


def test_links_of_a_crowded_bucket_are_few(spark, monkeypatch):
    """Families of similar lines in one bucket: each is one component before all of its pairs are formed."""
    monkeypatch.setattr(linededup, "bands", lambda: [[], []])  # twice one bucket of all lines
    monkeypatch.setattr(linededup, "HEADS", 2)
    monkeypatch.setattr(linededup, "WIDER", 4, raising=False)
    monkeypatch.setattr(linededup, "CHUNK", 32)
    edges, own = [], linededup.connected_components
    monkeypatch.setattr(linededup, "connected_components", lambda links: edges.append(links.count()) or own(links))
    rng = random.Random(3)
    base = [" ".join(words(rng, "en", 60)) for _ in range(12)]
    texts = [t for b in base for t in dict.fromkeys(edited(rng, b, 1) for _ in range(20))]
    want = plain_groups(texts)
    assert len(set(want.values())) == len(base)
    assert groups(spark, texts) == want
    assert max(edges) <= 6 * len(texts)  # within the families are over 2,000 pairs


def test_texts_are_not_split_for_the_result(spark):
    """The result reads numbers only."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, "en", 30)) for _ in range(20)]
    found = linededup.line_groups(frame(spark, [(i, t, None, None, None) for i, t in enumerate([*texts, texts[0]])]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan
    assert [r[:4] for r in rows_of(found) if not r[2]] == [(20, 0, False, 0)]


def test_texts_are_split_twice(spark, monkeypatch):
    """Once for the signatures and once for names and the texts that are compared."""
    plain, splits = linededup.cut, []

    def counted(df, *files):
        splits.append("split(" in df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, *files)

    monkeypatch.setattr(linededup, "cut", counted)
    line = " ".join(words(random.Random(6), "en", 40))
    texts = [line, line + " x", "", line]
    assert groups(spark, texts) == plain_groups(texts)
    assert sum(splits) == 2


def test_characters_beyond_two_bytes(spark):
    """A line with such a character shares all other shingles with the line without it; a byte order mark is a character."""
    rng = random.Random(8)
    text = " ".join(words(rng, "de", 40))
    texts = [text, text + " \U0001f600", "\ufeff" + text, "\ufeff" + text + "\U0001f600\U0001f601", "\U0001f600" * 40, "\U0001f600" * 30 + "a"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string").select("i", linededup.shingles(linededup.F.col("line"), 8).alias("hs"))
    sets = {i: set(hs) for i, hs in rows_of(got)}
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingles(a) & shingles(b))
    assert groups(spark, texts) == plain_groups(texts)


def test_signatures_are_compiled(spark):
    """No method is above the 8,000 bytes beyond which the JVM interprets; lines are counted and their minima those of all shingles."""
    line = linededup.F.col("line")
    rows = [("ab",), ("ab",), ("x" * 20 + "\U0001f600",), ("a line of text",)]
    signed = linededup.signatures(spark.createDataFrame(rows, "line string").select(*linededup.name(line), "line"), 8)
    told = signed._jdf.queryExecution().debug().codegenToSeq()
    assert all(told.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(told.size()))
    assert sorted(r.n for r in signed.collect()) == [1, 1, 2]


def test_least_shared(spark):
    sizes = spark.range(1, 3000).select(linededup.F.col("id").cast("int").alias("s"))
    for threshold in (0.8, 0.5, 0.7, 0.95, 1.0):
        for s, n in rows_of(sizes.select("s", linededup.least_shared(linededup.F.col("s"), threshold))):
            assert n >= threshold * (s - n) and not n - 1 >= threshold * (s - n + 1)
