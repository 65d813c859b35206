import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid
from tests.llm.fixtures import documents, frame, rows_of


def segmentations(word, p):
    """Sum over all ways to cut the word, the slow way."""
    total = 0.0
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            parts = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]
            total += math.prod(p.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts)
    return total


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "abab"]
    model = langid.fit({"x": {"abab": 3, "ba": 1}, "y": {"bb": 2, "q": 1}}, vocabulary)
    scorer = langid.Scorer(model)
    for word in ("a", "abab", "bbq", "ababab", "zz"):
        for k in range(2):
            p = dict(zip(vocabulary, model.p[:, k], strict=False))
            assert math.isclose(scorer.words([word])[0, k], math.log(segmentations("▁" + word, p)), rel_tol=1e-9)


def test_long_words_are_summed_in_one_pass():
    """A run of 2,000 letters, against the plain sums in logs; letters of no piece; nothing is cut or tied."""
    vocabulary = ["▁", "a", "b", "ab", "ba", "▁ab", "abababababab"]
    model = langid.fit({"x": {"abab": 3, "ba": 1}, "y": {"bb": 2, "q": 1}}, vocabulary)
    scorer = langid.Scorer(model)
    for word in ("ab" * 1000, "z" * 2000, "q" * 60 + "ab" * 30):
        marked = "▁" + word
        for k in range(2):
            p, logs = dict(zip(vocabulary, model.p[:, k], strict=False)), [0.0]
            for i in range(1, len(marked) + 1):
                parts = [logs[i - n] + math.log(q) for n in range(1, min(12, i) + 1) if (q := p.get(marked[i - n : i], langid.UNKNOWN if n == 1 else 0.0))]
                logs.append(max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts)))
            assert math.isclose(scorer.words([word])[0, k], logs[-1], rel_tol=1e-9)
    x, y = scorer.words(["ab" * 300])[0]
    assert x > y
    assert langid.runs("日" * 500) == ["日" * 500]


def test_expectation_by_enumeration():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    lattice = langid.Lattice(vocabulary)
    p = np.array([0.2, 0.1, 0.15, 0.2, 0.1, 0.05, 0.2, langid.UNKNOWN, 0])
    words = ["abab", "ba", "bbq"]
    ids, lengths = lattice.ids(words)
    got = langid.expected(ids, lengths, p, np.array([3.0, 1.0, 2.0]))
    want = np.zeros(len(p))
    for word, times in zip(words, (3, 1, 2), strict=True):
        marked, ways = "▁" + word, []
        for n in range(len(marked)):
            for cuts in itertools.combinations(range(1, len(marked)), n):
                parts = [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)], strict=True)]
                where = [vocabulary.index(x) if x in vocabulary else len(vocabulary) if len(x) == 1 else -1 for x in parts]
                if min(where) >= 0:
                    ways.append((math.prod(p[i] for i in where), where))
        total = sum(v for v, _ in ways)
        for v, where in ways:
            for i in where:
                want[i] += times * v / total
    assert np.allclose(got, want)


def test_rounds_raise_the_likelihood():
    counts, vocabulary = {"x": {"abab": 5, "abba": 2, "ba": 1}}, ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    said = []
    for rounds in (1, 2, 4, 8):
        s = langid.Scorer(langid.fit(counts, vocabulary, rounds))
        said.append(sum(n * s.words([w])[0, 0] for w, n in counts["x"].items()))
    assert all(b >= a - 0.05 for a, b in zip(said, said[1:], strict=False))


def test_hash_slots_do_not_confuse_pieces():
    vocabulary = langid.pieces(langid.default_vocabulary())
    lattice = langid.Lattice(vocabulary)
    ids, _ = lattice.ids([p.removeprefix("▁") for p in vocabulary if p.startswith("▁") and len(p) > 1][:5000])
    for w, row in zip([p for p in vocabulary if p.startswith("▁") and len(p) > 1][:5000], ids, strict=True):
        for i in range(len(w)):
            for n in range(1, row.shape[1] + 1):
                want = w[i : i + n] if i + n <= len(w) else None
                got = row[i, n - 1]
                assert (vocabulary[got] == want) if 0 <= got < len(vocabulary) else got == -1 or (n == 1)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents(300)
    got = {r[0]: r[1:] for r in rows_of(langid.language_id(frame(spark, rows, clash=True)))}
    assert len(got) == len(rows)
    out = [(got[r[0]][1], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[0] < 300]
    assert all(got[r[0]][0] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert len(out) > 50 and np.mean([a == b for a, b in out]) >= 0.95
    assert all(0 <= s <= 1 for _, _, s in got.values())
    for i in (340, 341, 342, 343):
        assert got[i][1:] == ("und", 0.0)
    assert got[344][1] == "en"


def test_lowest_keeps_the_smallest_hashes(spark):
    """What a full sort would choose is among the rows, which are few."""
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 300 == 0, "rare").otherwise("other").alias("lang"))
    kept = rows_of(langid.lowest(ids, 100).withColumn("h", F.xxhash64("doc_id")))
    every = rows_of(ids.withColumn("h", F.xxhash64("doc_id")))
    for lang in ("hot", "rare", "other"):
        smallest = sorted((h, d) for d, g, h in every if g == lang)[:100]
        own = sorted((h, d) for d, g, h in kept if g == lang)
        assert own[:100] == smallest and len(own) < 400
    assert rows_of(langid.lowest(ids.limit(0), 100)) == []


def test_lang_and_source_are_no_inputs(spark):
    rows = documents(60)
    model = langid.train(frame(spark, rows))
    one = rows_of(langid.predict(spark, frame(spark, rows).select("doc_id", "text"), model))
    other = rows_of(langid.predict(spark, frame(spark, rows).select((F.col("doc_id") * 1).alias("doc_id"), "text"), model))
    assert sorted(one) == sorted(other)


def test_no_labels_and_empty(spark):
    rows = [(1, "text", None, None, 4), (None, "more", "en", None, 4)]
    assert sorted(r[2] for r in rows_of(langid.language_id(frame(spark, rows)))) == ["und", "und"]
    assert rows_of(langid.language_id(frame(spark, []))) == []


def test_rejects_go(spark):
    rows = documents(60)
    df = frame(spark, rows)
    kept = langid.recognised(spark, df, langid.train(df))
    assert kept.columns == df.columns
    assert {r[0] for r in rows} - {r[0] for r in rows_of(kept)} >= {100, 101, 102, 103}
    assert {r[0] for r in rows_of(kept)} >= set(range(60))
