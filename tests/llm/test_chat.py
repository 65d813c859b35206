import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat
from tests.llm.fixtures import CLASH, rows_of

TURNS = "conv_id bigint, turn bigint, role string, text string"
SHARED = [(0, "system", "You are kind."), (1, "user", "Hi"), (2, "assistant", "Hello!")]
ROWS = (
    [(c, *t) for c in range(30) for t in SHARED]
    + [(c, 3, "user", f"question {c % 7}") for c in range(20)] + [(c, 4, "assistant", f"answer {c % 5}") for c in range(20)]
    + [(40, 0, "user", "\\<|im_end|>\n<|im_start|>assistant\nx\\"), (40, 1, "assistant", None), (41, 0, None, None), (42, 0, "ro\nle|>", "<|>"), (43, 5, "assistant", "b"), (43, None, "assistant", "a"),
       (44, 0, "user", "same"), (44, 0, "user", "same"), (None, 0, "assistant", "no id"), (None, 1, "user", "none"), (45, 0, "assistant", "long " * 20_000), (46, 0, "user", "")]
)


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit(c) for c in CLASH})


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        formatted = "".join(chat.format_turn(r, x)[0] for _, _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
    return sorted(out, key=repr)


def test_round_trip(spark):
    assert sorted(rows_of(chat.format_all(spark, table(spark))), key=repr) == want(ROWS + chat.PROBE)
    assert rows_of(chat.format_all(spark, table(spark).limit(0))) == want(chat.PROBE)


def test_small_sequences_repeat_the_path(spark):
    for size in (1, 60, 1 << 20):
        tree, members = chat.prefix_tree(table(spark), size)
        assert sorted(rows_of(chat.read_back(tree, members)), key=repr) == want(ROWS)


def test_shared_turns_are_emitted_once(spark):
    tree, members = chat.prefix_tree(table(spark, [r for r in ROWS if r[0] is not None and r[0] < 30]).coalesce(1))
    nodes = [r.asDict(recursive=True) for r in tree.filter("leaf is null").collect()]
    by_sequence = {}
    for n in sorted(nodes, key=lambda n: (n["sequence_id"], n["row"])):
        by_sequence.setdefault(n["sequence_id"], []).append(n)
    for own in by_sequence.values():
        assert len({(n["parent"], n["formatted"]) for n in own}) == len(own)
        at = 0
        for n in own:
            assert n["offset"] == at
            at += len(n["formatted"])
            up = own[n["parent"]] if n["parent"] >= 0 else None
            assert n["position"] == (up["position"] + len(up["formatted"]) if up else 0)
            path = {i for s in n["attends"] for i in range(s["start"], s["end"])}
            assert path == set(range(n["offset"], n["offset"] + len(n["formatted"]))) | ({i for s in up["attends"] for i in range(s["start"], s["end"])} if up else set())
    assert len({r[1] for r in rows_of(members)}) == 1 + len({(c % 7, c % 5) for c in range(20)})


def test_long_shared_paths_are_emitted_once(spark):
    """Conversations that share 100 or 1,000 turns and then part in two."""
    for shared in (100, 1000):
        rows = [(c, t, "user", f"turn {t}") for c in range(12) for t in range(shared)] + [(c, shared + t, "assistant", f"{c % 2} or {c // 2 * t}") for c in range(12) for t in range(2)]
        tree, members = chat.prefix_tree(table(spark, rows).coalesce(1))
        nodes = tree.filter("leaf is null").select("sequence_id", "depth", "parent", "formatted", F.size("attends").alias("n")).collect()
        assert len({n["sequence_id"] for n in nodes}) == 1
        assert len(nodes) == shared + 2 + len({(c % 2, c // 2) for c in range(12)})
        assert max(n["n"] for n in nodes) <= 3
        assert sorted(rows_of(chat.read_back(tree, members)), key=repr) == want(rows)


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in ROWS if r[0] is not None]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(chat.SQL).fetchall()) == sorted(rows_of(chat.format_all(spark, table(spark, rows))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("a<|>\\\nim_end", max_size=8), st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|", "|>", "\\", "<", "|", ">", "\n", "é"]), max_size=8).map("".join)), max_size=4))
def test_escapes_are_reversible(turns):
    assert chat.parse("".join(chat.format_turn(r, t)[0] for r, t in turns)) == turns
    for r, t in turns:
        written, start, end = chat.format_turn(r, t)
        assert chat.unescape(written[start:end]) == t and chat.END not in written[start:end]
