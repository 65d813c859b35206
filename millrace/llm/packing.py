"""Order-preserving packing of documents into windows of at most WINDOW tokens.

Documents are tokenised where they are read, without a shuffle, and the cuts of each
partition's token stream are chosen by dynamic programming. Candidates are all document and
sentence ends; a stretch of over WINDOW tokens without one also gets a candidate every WINDOW
tokens. A cut costs nothing at a document's end, SENTENCE within a document, INSIDE within a
sentence; a window costs its padding. As padding is linear in the window's start, the best
start is the minimum of a sliding window, kept in a monotone queue: each candidate enters and
leaves once. Whatever follows, the best cuts go through one of the starts in the queue; every
CHUNK tokens the cuts that all of these share are settled and their windows leave. So the
cuts are the best of the whole stream, and memory does not grow with a partition (a single document
is held whole).

A sequence whose length is a power of two is not padded; the last, short window of a partition
is therefore split into powers of two where that costs less than its padding.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
SENTENCE = 8
INSIDE = 64
#: Tokens after which settled cuts are looked for.
CHUNK = 16 * WINDOW
END = 2
#: What ends a sentence, where no letter or digit stands beside it in a token.
STOPS = ".!?。！？؟।…"
#: Marks that are split off a chunk; each is neither letter, digit nor white space, begins no contraction and stands in no special token.
MARKS = ".,;:!?\"#$%&()*+-/=@[\\]^_`{}~"
#: Chunks not made of Latin-1 letters and marks whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 100_000
#: Bytes of a chunk that is merged in numpy, words merged together, and what no token's id is.
LONGEST, COLUMNS, OUTSIDE = 64, 4096, (1 << 20) - 1
#: Bytes of text that are encoded together (a single document is not split).
TOGETHER = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merges of many words of up to LONGEST bytes at once, in numpy.

    In each round every word merges its pair of lowest rank, the leftmost of several. Words of
    about the same length are the columns of a table with a row for each place, in which each
    place knows the next and the previous one that is left.
    """

    def __init__(self, merges: list, vocabulary: dict[str, int]):
        self.single, self.last = (np.array([vocabulary[chr(BYTE_CHARS.get(b, b)) + end] for b in range(256)]) for end in ("", "</w>"))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.made = np.array([vocabulary[a + b] for a, b in pairs])
        self.none = len(pairs)
        # an open hash table of pair << 20 | rank
        self.shift = 64 - max(8, (4 * len(pairs)).bit_length())
        self.table = np.full((1 << 64 - self.shift) + len(pairs), -1, np.int64)
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs])
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.table[at] >= 0:
                at += 1
            self.table[at] = key << 20 | rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = self._slot(key)
        found = self.table[at]
        rank = np.where(found >> 20 == key, found & 0xFFFFF, self.none)
        rest = np.flatnonzero((found >= 0) & (found >> 20 != key))
        while len(rest):
            at[rest] += 1
            found = self.table[at[rest]]
            hit = found >> 20 == key[rest]
            rank[rest[hit]] = found[hit] & 0xFFFFF
            rest = rest[(found >= 0) & ~hit]
        return rank

    def ids(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, n): the ids of word i are ids[first[i] : first[i] + n[i]]. The words' bytes in one, and their ends; none is empty."""
        sizes = np.diff(np.r_[0, ends])
        order = np.argsort(sizes, kind="stable")
        parts, n = [np.zeros(0, np.int64)], np.zeros(len(ends), np.int64)
        at = 0
        while at < len(order):
            width = int(sizes[order[at]]) + 1
            end = min(at + COLUMNS, int(np.searchsorted(sizes, width, "right", sorter=order)))
            own = order[at:end]
            ids, n[own] = self._table(raw, ends[own] - sizes[own], sizes[own])
            parts.append(ids)
            at = end
        first = np.zeros(len(ends), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(parts), first, n

    def _table(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, width = len(sizes), int(sizes.max())
        place = np.arange(width)[:, None]
        # a row before and one after the words' places, of a symbol that no pair has
        symbol = np.full((width + 2, words), OUTSIDE)
        symbol[1:-1] = np.where(place < sizes, self.single[raw[np.minimum(begins + place, len(raw) - 1)]], OUTSIDE)
        symbol[sizes, np.arange(words)] = self.last[raw[begins + sizes - 1]]
        symbol = symbol.ravel()
        after, before = np.arange(len(symbol)) + words, np.arange(len(symbol)) - words
        none = self.none << 32
        # by rank, then place
        best = np.full(len(symbol), none)
        inner = np.arange(words, words * (width + 1))
        best[inner] = self._rank(symbol[inner], symbol[inner + words]) << 32 | inner
        while True:
            least = best.reshape(-1, words).min(axis=0)
            least = least[least < none]
            if not len(least):
                break
            at = least & 0xFFFFFFFF
            gone = after[at]
            then, prior = after[gone], before[at]
            made = self.made[least >> 32]
            symbol[at], symbol[gone], best[gone] = made, -1, none
            after[at], before[then] = then, at
            best[at] = self._rank(made, symbol[then]) << 32 | at
            best[prior] = self._rank(symbol[prior], made) << 32 | prior
        table = symbol.reshape(-1, words)[1:-1].T
        left = (table >= 0) & (table != OUTSIDE)
        return table[left], left.sum(axis=1)


class WordIds:
    """Ids of texts. The pre-tokeniser never crosses white space, so of many texts each distinct chunk is encoded once.

    A chunk of Latin-1 letters, then marks, is one pre-token each, in the normal form once
    lower-cased; these go straight to the merges, all others to the tokeniser.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.merges = Merges(json.loads(Path(path).read_text("utf-8"))["model"]["merges"], self.tokenizer.get_vocab())
        self.known: dict[bytes, list[int]] = {}
        size = self.tokenizer.get_vocab_size() + 1
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            bare = _plain(token.removesuffix("</w>"))
            self.ends[i] = token.endswith("</w>") and any(c in STOPS for c in bare) and not any(c.isalnum() for c in bare)

    def _others(self, chunks: list[bytes]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, new = self.known, [c for c in chunks if c not in self.known]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            known.update(zip(part, (e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)), strict=True))
        return [known[c] for c in chunks]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, n): the ids of chunk i (bytes that end in a space) are ids[first[i] : first[i] + n[i]]."""
        raw, ends = _bytes_of(chunks)
        owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        lead, follow = raw[:-1], raw[1:]
        pair = np.append(((lead == 0xC3) & _IS_C3[follow]) | ((lead == 0xC2) & _IS_C2[follow]), False)
        second = np.r_[False, pair[:-1]]
        letter, mark = _IS_LETTER[raw] | pair | second, _IS_MARK[raw]
        strange = ~(letter | mark | (raw == 32))
        strange[1:] |= letter[1:] & mark[:-1]
        plain = np.ones(len(ends), bool)
        plain[owner[strange]] = False
        plain &= np.diff(np.r_[0, ends]) <= LONGEST

        at = np.flatnonzero((letter | mark) & plain[owner])
        low, marks, of = np.where(second, _LOWER_C3[raw], _LOWER[raw])[at], mark[at], owner[at]
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (marks[1:] != marks[:-1])]) if len(at) else at
        words = _binary(low, np.append(starts[1:], len(at)) if len(at) else at).dictionary_encode()
        word = words.indices.to_numpy(zero_copy_only=False)
        ids, first, sizes = self.merges.ids(*_bytes_of(words.dictionary))
        ids, n = _gathered(ids, first, sizes, word), np.bincount(of[starts], sizes[word], len(ends)).astype(np.int64)
        first = np.cumsum(n) - n
        if len(rest := np.flatnonzero(~plain)):
            found = self._others([c[:-1] for c in chunks.take(pa.array(rest)).to_pylist()])
            n[rest] = [len(x) for x in found]
            first[rest] = len(ids) + np.cumsum(n[rest]) - n[rest]
            ids = np.append(ids, np.fromiter(chain.from_iterable(found), np.int64))
        return ids, first, n

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        data = np.where((data == 9) | (data == 10), np.uint8(32), data)
        ends = np.flatnonzero(data == 32) + 1
        chunks = _binary(data, ends).dictionary_encode()
        ids, first, n = self._chunks(chunks.dictionary)
        # after a document's last chunk comes one that is END
        last = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw])) + 1
        chunk = np.insert(chunks.indices.to_numpy(zero_copy_only=False), last, len(n))
        ids, first, n = np.append(ids, END).astype("<u4"), np.append(first, len(ids)), np.append(n, 1)
        stops = np.cumsum(n[chunk])[last + np.arange(len(last))].tolist()
        every = _gathered(ids, first, n, chunk)
        return [every[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of the strings of bytes that end at ``ends``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in one, and their ends."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at[1:] - at[0]


def _gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each i of ``of`` the n[i] values from first[i] on, one after the other."""
    sizes = n[of]
    stops = np.cumsum(sizes)
    return values[np.repeat(first[of] - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_chars() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(shown))}


BYTE_CHARS = _byte_chars()
_BYTE = np.arange(256, dtype=np.uint8)
_IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_IS_MARK = np.array([chr(b) in MARKS for b in range(256)])
#: Latin-1 letters of two bytes, by the second one, after 0xC2 and 0xC3; their lower case differs in that one only.
_IS_C2, _IS_C3 = (np.array([0x80 <= b < 0xC0 and bytes([lead, b]).decode().isalpha() for b in range(256)]) for lead in (0xC2, 0xC3))
_LOWER = np.where(_IS_LETTER & (_BYTE < ord("a")), _BYTE + 32, _BYTE).astype(np.uint8)
_LOWER_C3 = np.where(_IS_C3 & (_BYTE < 0x9F), _BYTE + 32, _BYTE).astype(np.uint8)
_BYTES = {chr(c): chr(b) for b, c in BYTE_CHARS.items()}
_WORDS: dict[tuple[str, bool], WordIds] = {}


def _plain(token: str) -> str:
    """The text of a token of byte-level characters; '' where its bytes are no whole characters."""
    raw = "".join(_BYTES.get(c, c) for c in token)
    return raw.encode("latin-1").decode("utf-8", "ignore") if _latin(raw) else ""


def word_ids(path: str, special: bool = True) -> WordIds:
    """One to a worker process, so that its memory serves the tasks that follow."""
    if (path, special) not in _WORDS:
        _WORDS[path, special] = WordIds(path, special)
    return _WORDS[path, special]


def candidates(ids: list[np.ndarray], ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the cuts of consecutive documents' tokens; ends: by id."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    total = int(sizes.sum())
    flat = np.concatenate(ids)
    inner = np.flatnonzero(ends[flat]) + 1
    last = np.cumsum(sizes)
    at = np.union1d(inner, last)
    cost = np.where(np.isin(at, last, assume_unique=False), 0, SENTENCE)
    gaps = np.flatnonzero(np.diff(np.r_[0, at]) > window)
    if len(gaps):
        starts = np.r_[0, at]
        extra = np.concatenate([np.arange(starts[g] + window, at[g], window) for g in gaps])
        at, cost = np.r_[at, extra], np.r_[cost, np.full(len(extra), INSIDE)]
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    assert at[-1] == total
    return at, cost


class Cuts:
    """The dynamic programme over a stream of candidates; positions count from the last settled cut."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.position, self.key, self.back = [0], [0], [0]  # key: value + position, what a start adds to a window's cost
        self.queue: deque[int] = deque([0])
        self.end = 0

    def extend(self, at: np.ndarray, cost: np.ndarray) -> None:
        """Candidates that follow, from the stream's end on; ascending, with gaps of at most ``window``."""
        position, key, back, queue, window, end = self.position, self.key, self.back, self.queue, self.window, self.end
        i = len(position)
        for p, penalty in zip((at + end).tolist(), cost.tolist(), strict=True):
            low = p - window
            while position[queue[0]] < low:
                queue.popleft()
            j = queue[0]
            k = key[j] + window + penalty
            position.append(p)
            key.append(k)
            back.append(j)
            while queue and key[queue[-1]] >= k:
                queue.pop()
            queue.append(i)
            i += 1
        self.end = position[-1]

    def _path(self, i: int) -> list[int]:
        cuts = []
        while i > 0:
            cuts.append(self.position[i])
            i = self.back[i]
        return cuts[::-1]

    def settled(self) -> list[int]:
        """The cuts that the best ways to all possible starts share; positions count from the last of them afterwards."""
        heads = [-i for i in self.queue]
        heapq.heapify(heads)
        while True:
            last = -heads[0]
            while heads and -heads[0] == last:
                heapq.heappop(heads)
            if not heads:
                break
            heapq.heappush(heads, -self.back[last])
        cuts = self._path(last)
        if cuts:
            self.position = [p - cuts[-1] for p in self.position[last:]]
            self.key, self.back = self.key[last:], [max(0, i - last) for i in self.back[last:]]
            self.queue = deque(i - last for i in self.queue)
            self.end -= cuts[-1]
        return cuts

    def finish(self, tail=None) -> list[int]:
        """All cuts that are left; tail: the cost of a last window by its length, its padding if not given."""
        last = len(self.position) - 1
        if not last:
            return []
        start = self.back[last]
        if tail is not None:
            starts = {start, *(i for i in self.queue if i != last and self.end - self.position[i] <= self.window)}
            start = min(starts, key=lambda i: (self.key[i] - self.position[i] + tail(self.end - self.position[i]), -i))
        return [*self._path(start), self.end]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows that minimise padding plus penalties; at: ascending, gaps of at most ``window``."""
    cuts = Cuts(window)
    cuts.extend(at, cost)
    return cuts.finish()


def tail_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences that a last window of n tokens becomes."""
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return powers if (len(powers) - 1) * INSIDE < window - n else [n]


def tail_cost(n: int, window: int = WINDOW) -> int:
    """Of a last window of n tokens, split or not."""
    parts = tail_lengths(n, window)
    return (len(parts) - 1) * INSIDE if parts != [n] else 0 if n & (n - 1) == 0 else window - n


class Packer:
    """Documents in, pieces out: (number of the document, start, ids, sequence, offset)."""

    def __init__(self, ends: np.ndarray, window: int = WINDOW, chunk: int = CHUNK, split_tail: bool = True):
        self.ends, self.window, self.chunk, self.split_tail = ends, window, chunk, split_tail
        self.cuts = Cuts(window)
        self.sequence = 0
        self.docs: deque[tuple[int, int, np.ndarray]] = deque()  # number, tokens already emitted, the rest
        self.new = 0

    def add(self, first: int, documents: list[np.ndarray]) -> Iterator[tuple]:
        """Documents numbered from ``first`` on."""
        self.docs.extend((first + i, 0, ids) for i, ids in enumerate(documents))
        self.cuts.extend(*candidates(documents, self.ends, self.window))
        self.new += sum(map(len, documents))
        if self.new >= self.chunk:
            self.new = 0
            yield from self._emit(self.cuts.settled())

    def finish(self) -> Iterator[tuple]:
        cuts = self.cuts.finish((lambda n: tail_cost(n, self.window)) if self.split_tail else None)
        if not self.split_tail:
            yield from self._emit(cuts)
        elif cuts:
            start = cuts[-2] if len(cuts) > 1 else 0
            yield from self._emit(cuts[:-1] + (start + np.cumsum(tail_lengths(cuts[-1] - start, self.window))).tolist())

    def _emit(self, cuts: list[int]) -> Iterator[tuple]:
        begin = 0
        for end in cuts:
            offset = 0
            while begin + offset < end:
                number, before, ids = self.docs[0]
                n = min(len(ids), end - begin - offset)
                yield number, before, ids[:n], self.sequence, offset
                offset += n
                if n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (number, before + n, ids[n:])
            begin, self.sequence = end, self.sequence + 1


def together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows whose texts have up to TOGETHER bytes; a larger one stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield at, end - at
        at = end


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False, special: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for each piece of each document.

    A document is its text's ids and the id END; a null text counts as empty, so every row
    has at least one piece. start: the document's ids before the piece; offset: the piece's
    place in its sequence. Documents keep the order in which they are read; a sequence holds
    documents of one partition. Rows that repeat a doc_id, or have none, are documents of
    their own. Other columns are ignored. The names of special tokens in a text are those
    tokens, as the tokenizer has it; with ``special`` false they are ordinary text.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, special)
        packer = Packer(words.ends, window)
        base = TaskContext.get().partitionId() << 40
        known: dict[int, tuple[int | None, int]] = {}
        number = 0

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            own = [known[p[0]] for p in pieces]
            columns = [
                pa.array([d for d, _ in own], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
                pa.array([n for _, n in own], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        gc.disable()  # nothing here makes cycles, and the chunks remembered are many
        try:
            for b in batches:
                for at, n in together(b.column(1)):
                    part = b.slice(at, n)
                    ids = words.texts(part.column(1).to_pylist())
                    known.update((number + i, (d, len(x))) for i, (d, x) in enumerate(zip(part.column(0).to_pylist(), ids, strict=True)))
                    pieces = list(packer.add(number, ids))
                    number += len(ids)
                    if pieces:
                        yield batch_of(pieces)
                        for n in [n for n in known if n < packer.docs[0][0]] if packer.docs else list(known):
                            del known[n]
            if pieces := list(packer.finish()):
                yield batch_of(pieces)
        finally:
            gc.enable()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
