from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__
from millrace.llm import langid
from tests.llm.fixtures import documents, frame, rows_of
from tests.llm.test_linededup import blank, plain_groups
from tests.llm.test_mixing import size_of
from tests.llm.test_packing import encoder
from tests.llm.test_simhash import components, plain_fingerprint


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents(80)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        made.append([r.asDict() for r in docs.collect()])
    recognised, lines, near, mixed, packed = made

    gone = {r[0] for r in rows} - {r["doc_id"] for r in recognised}
    assert {120, 121, 122, 123} <= gone and len(gone) <= 6

    first = plain_groups([(r["doc_id"], r["text"]) for r in recognised])
    want = {}
    for r in recognised:
        parts = r["text"].split("\n")
        kept = [x for i, x in enumerate(parts) if blank(x) or first[r["doc_id"], i] == (r["doc_id"], i)]
        if not blank("\n".join(kept)):
            want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in lines} == want

    group = components({r["doc_id"]: plain_fingerprint(r["text"]) for r in lines})
    assert sorted(r["doc_id"] for r in near) == sorted(set(group.values()))

    size = {r["doc_id"]: size_of(r["text"]) for r in near}
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += size_of(r["text"])
    assert all(n <= 2 * size[d] for d, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 0.02 * sum(size.values())

    t, ids = encoder(), defaultdict(int)
    for r in mixed:
        ids[r["doc_id"]] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == ids
    assert Counter(r[0] for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id"))) == Counter(r["doc_id"] for r in packed)


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == []


def test_columns_stay(spark, tmp_path):
    docs = frame(spark, documents(40))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert "pipeline" in __spark_entry__.queries() and langid.SAMPLE_DOCS > 0
