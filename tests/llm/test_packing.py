import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing
from tests.llm.fixtures import documents, frame, rows_of


def encoder():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def held(pieces, docs):
    """Every id in exactly one piece; sequences gapless and short enough."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, tokens, sequence, offset in pieces:
        by_doc[doc_id].append((start, length, crc, tokens))
        by_sequence[sequence].append((offset, length))
    t = encoder()
    for doc_id, text in docs.items():
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc, tokens in sorted(by_doc[doc_id]):
            assert (start, tokens, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes())) and length > 0
            at += length
        assert at == len(ids)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding, total


def test_brute_force(spark):
    rows = documents()
    pieces = rows_of(packing.pack(frame(spark, rows, clash=True)))
    padding, total = held(pieces, {r[0]: r[1] for r in rows})
    assert padding < 0.1 * total


def test_nulls_and_empty(spark):
    got = rows_of(packing.pack(frame(spark, [(None, None, None, None, None), (1, "", None, None, 0)])))
    assert sorted((r[0] or 0, r[1], r[2], r[4]) for r in got) == [(0, 0, 1, 1), (1, 0, 1, 1)]
    assert rows_of(packing.pack(frame(spark, []))) == []
    with_ids = rows_of(packing.pack(frame(spark, [(1, "hello there.", None, None, 0)]), with_ids=True))
    assert with_ids[0][-1] == [*encoder().encode("hello there.", add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text("aZéßµ'.,!…-1 \n\t日́İΣ<|>", max_size=8), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>"])), max_size=5).map("".join), max_size=6))
def test_remembered_chunks_encode_as_whole_texts(texts):
    t, own = encoder(), packing.word_ids(packing.default_tokenizer())
    assert [x.tolist() for x in own.texts(texts)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_many_distinct_words_are_not_remembered():
    """Words and marks after them are merged together and leave nothing in the worker's memory."""
    rng = np.random.default_rng(3)
    letters, marks = list("aabcdeeinrstthßéÀZ"), ["", "", ".", "###", "%%%", ",***", '"', "_("]
    chunks = ["".join(rng.choice(letters, rng.integers(1, 14))) + rng.choice(marks) for _ in range(30_000)]
    chunks += ["a" * n for n in range(1, 140)] + ["\u00b5\u00d7", "...", "it's", "a.b", "3.5%", "x²!", "«a»", "\u0301.", "e\u0301=", "ab<|endoftext|>..", "ÀÞ\u00ff\u00df\u00d7"]
    texts = [" ".join(chunks[at : at + 500]) for at in range(0, len(chunks), 500)]
    t, own = encoder(), packing.WordIds(packing.default_tokenizer())
    assert [x.tolist() for x in own.texts(texts)] == [[*e.ids, 2] for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(own.known) < 200


def test_texts_are_encoded_in_bounded_groups():
    texts = pa.array(["a" * n if n else None for n in (0, 5, packing.TOGETHER, 3, packing.TOGETHER + 1, 0, 7)])
    assert list(packing.together(texts)) == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 2)]
    assert list(packing.together(texts.slice(5))) == [(0, 2)]
    assert list(packing.together(texts.slice(0, 0))) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 8, 64])), min_size=1, max_size=14))
def test_cuts_are_optimal(steps):
    at, cost, window = np.cumsum([s for s, _ in steps]), np.array([c for _, c in steps]), 16
    best = {0: 0}
    for p, c in zip(at.tolist(), cost.tolist(), strict=True):
        best[p] = min(v + window - (p - q) + c for q, v in best.items() if p - q <= window)
    cuts = packing.best_cuts(at, cost, window)
    penalty = dict(zip(at.tolist(), cost.tolist(), strict=True))
    got = sum(window - (b - a) + penalty[b] for a, b in zip([0, *cuts], cuts, strict=False))
    assert cuts[-1] == at[-1] and all(b - a <= window for a, b in zip([0, *cuts], cuts, strict=False))
    assert got == best[int(at[-1])]


def test_tail_in_powers_of_two():
    assert packing.tail_lengths(4000) == [4000]
    assert packing.tail_lengths(2500) == [2048, 256, 128, 64, 4]
    assert sum(packing.tail_lengths(1)) == 1


def test_special_tokens_can_be_text(spark):
    rows = [(1, "one<|endoftext|> two", None, None, 0)]
    plain, text = encoder(), encoder()
    text.encode_special_tokens = True
    for special, t in ((True, plain), (False, text)):
        got = rows_of(packing.pack(frame(spark, rows), with_ids=True, special=special))
        assert [i for r in sorted(got) for i in r[-1]] == [*t.encode(rows[0][1], add_special_tokens=False).ids, 2]
    assert 49407 in plain.encode(rows[0][1], add_special_tokens=False).ids


def test_sentence_ends_of_several_scripts():
    words = packing.word_ids(packing.default_tokenizer())
    for text in ("end.", "what?", "終わり。", "no!"):
        assert words.ends[words.texts([text])[0][-2]], text
    assert not words.ends[words.texts(["3.5"])[0][0]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=4), min_size=1, max_size=25), st.integers(1, 60), st.integers(0, 3))
def test_a_stream_is_cut_as_a_whole(batches, chunk, every):
    """The cuts of a stream cost as little as the best cuts of all of it at once, by brute force."""
    window, ends = 16, np.zeros(10, bool)
    ends[4] = True
    packer, out, documents, number = packing.Packer(ends, window, chunk, split_tail=False), [], [], 0
    for batch in batches:
        ids = [np.array([4 if every and i % (every + 1) == 0 else 3 for i in range(n)], "<u4") for n in batch]
        out += list(packer.add(number, ids))
        number += len(ids)
        documents += ids
    out += list(packer.finish())
    at, cost = packing.candidates(documents, ends, window)
    penalty, sizes = dict(zip(at.tolist(), cost.tolist(), strict=True)), defaultdict(int)
    best = {0: 0}
    for p, c in penalty.items():
        best[p] = min(v + window - (p - q) + c for q, v in best.items() if p - q <= window)
    for _, _, ids, sequence, _ in out:
        sizes[sequence] += len(ids)
    got = place = 0
    for k in sorted(sizes):
        place += sizes[k]
        got += window - sizes[k] + penalty[place]
    assert place == at[-1] and got == best[place]


def test_long_streams_keep_order():
    ends = np.zeros(10, bool)
    packer, out = packing.Packer(ends, window=8, chunk=32), []
    for i in range(40):
        out += list(packer.add(i, [np.full(1 + i % 5, 3, "<u4")]))
    out += list(packer.finish())
    seen = [(n, start) for n, start, *_ in out]
    assert seen == sorted(seen) and sum(len(x[2]) for x in out) == sum(1 + i % 5 for i in range(40))
