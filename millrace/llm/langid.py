"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its words. The piece probabilities are fitted by expectation
maximisation (forward and backward sums) on a bounded sample of labelled rows: at most
``sample_docs`` documents a language, chosen by a hash of their id, with all their words.
Every text is scored whole.

Words are runs of letters of the lower-cased text, of any length; pieces are as long as the
vocabulary's longest. The sums are scaled at every letter, so that none is too small for a
double, and a word's sums are kept for as many letters back as a piece is long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 500
ROUNDS = 4
UNKNOWN = 1e-7
SMOOTH = 0.1
#: Chunks between white space whose score a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Letters of the words whose lattices are in memory at a time.
BLOCK = 1 << 15
MARK = "▁"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word-start mark, by length and text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    kept = {p for p in own if p == p.lower() and (p == MARK or _LETTERS.fullmatch(p.removeprefix(MARK)))}
    return sorted(kept | {MARK}, key=lambda p: (len(p), p))


def runs(text: str) -> list[str]:
    return _LETTERS.findall(text)


class Lattice:
    """Piece ids of all substrings of words; id len(vocabulary) is a single unknown character."""

    def __init__(self, vocabulary: list[str]):
        self.unknown = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        size = 1 << max(16, (len(vocabulary) * 32).bit_length())
        self.mask = np.uint64(size - 1)
        keys = np.zeros(len(vocabulary), np.uint64)
        for i, p in enumerate(vocabulary):
            h = 0
            for ch in p:
                h = ((h + ord(ch) + 1) * int(_MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        self.more: dict[int, int] = {}
        for i, h in enumerate(keys):
            at = int((h >> np.uint64(20)) & self.mask)
            if self.slot[at] < 0:
                self.slot[at] = i
            else:
                self.more[int(h)] = i
        self.clash = np.array(sorted(self.more), np.uint64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Id of each hash, -1 for what is no piece."""
        at = self.slot[((h >> np.uint64(20)) & self.mask).astype(np.int64)]
        found = np.where((at >= 0) & (self.keys[at] == h), at, -1)
        if len(self.clash):
            other = (at >= 0) & (found < 0)
            if other.any():
                rest = h[other]
                i = np.minimum(np.searchsorted(self.clash, rest), len(self.clash) - 1)
                hit = self.clash[i] == rest
                ids = np.full(len(rest), -1, np.int64)
                ids[hit] = [self.more[int(x)] for x in rest[hit]]
                found[other] = ids
        return found

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids[n, i, l-1] of the piece at i of length l of each marked word, and the words' lengths."""
        marked = [MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        width = int(lengths.max())
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), "<u4").reshape(len(marked), width).astype(np.uint64)
        out = np.full((len(marked), width, min(self.longest, width)), -1, np.int64)
        h = np.zeros_like(codes)
        for n in range(1, out.shape[2] + 1):
            h = (h[:, : width - n + 1] + codes[:, n - 1 :] + np.uint64(1)) * _MULTIPLIER
            out[:, : width - n + 1, n - 1] = self.lookup(h)
        single = out[:, :, 0]
        single[single < 0] = self.unknown
        out[np.arange(width)[None, :] + np.zeros((len(marked), 1), np.int64) >= lengths[:, None]] = -1
        return out, lengths


def forward(ids: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of each word's sum over all its segmentations, by language. p: (pieces + 2) x languages, the last row 0.

    recent[j] holds the sums over the first i - j letters, all divided by the same scale. Only
    pieces that some word of the block has at a place are looked at there.
    """
    n, width, most = ids.shape
    recent = np.zeros((most, n, p.shape[1]))
    recent[0] = 1
    scale, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    some = (ids >= 0).any(axis=0)
    for i in range(1, width + 1):
        now = np.zeros((n, p.shape[1]))
        for length in range(1, min(most, i) + 1):
            if some[i - length, length - 1]:
                now += recent[(i - length) % most] * p[ids[:, i - length, length - 1]]
        if i % 4 == 0 or i == width:  # a letter is worth 1e-7 at least: four are far from a double's end
            by = np.where(now > 0, now, 1.0)
            recent /= by
            now, scale = now / by, scale + np.log(by)
        ended = lengths == i
        if ended.any():
            out[ended] = np.log(now[ended]) + scale[ended]
        recent[i % most] = now
    return out


def expected(ids: np.ndarray, lengths: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, weighed: one step of expectation. p: by piece, for one language."""
    n, width, most = ids.shape
    alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    up, down = np.zeros((n, width + 1)), np.zeros((n, width + 1))  # logs of the scales
    alpha[:, 0], beta[np.arange(n), lengths] = 1, 1
    for i in range(1, width + 1):
        for length in range(1, min(most, i) + 1):
            alpha[:, i] += alpha[:, i - length] * np.exp(up[:, i - length] - up[:, i - 1]) * p[ids[:, i - length, length - 1]]
        by = np.where(alpha[:, i] > 0, alpha[:, i], 1.0)
        alpha[:, i] /= by
        up[:, i] = up[:, i - 1] + np.log(by)
    for i in range(width - 1, -1, -1):
        last = np.where(lengths > i, 0.0, 1.0)
        for length in range(1, min(most, width - i) + 1):
            beta[:, i] += beta[:, i + length] * np.exp(down[:, i + length] - down[:, i + 1]) * p[ids[:, i, length - 1]]
        by = np.where((beta[:, i] > 0) & (last == 0), beta[:, i], 1.0)
        beta[:, i] /= by
        down[:, i] = down[:, i + 1] + np.log(by)
    whole = up[np.arange(n), lengths]
    out = np.zeros(len(p))
    for length in range(1, most + 1):
        at = ids[:, : width - length + 1, length - 1]
        end = at.shape[1]
        logs = np.minimum(up[:, :end] + down[:, length : length + end] - whole[:, None], 700)
        part = np.where(at >= 0, alpha[:, :end] * p[at] * beta[:, length : length + end] * np.exp(logs) * weight[:, None], 0)
        out += np.bincount(at.ravel() % len(p), part.ravel(), len(p))
    return out


def blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of about the same length, about BLOCK letters at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + max(1, BLOCK // (int(lengths[order[at]]) + 1))
        while end > at + 1 and (end - at) * (int(lengths[order[min(end, len(order)) - 1]]) + 1) > 2 * BLOCK:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[str]
    p: np.ndarray  # (pieces + 2) x languages; the last two rows: an unknown character, no piece

    def lattice(self) -> Lattice:
        return Lattice(self.vocabulary)


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its words' counts."""
    languages, lattice, size = sorted(counts), Lattice(vocabulary), len(vocabulary)
    p = np.zeros((size + 2, max(1, len(languages))))
    for k, language in enumerate(languages):
        words = list(counts[language])
        weight = np.fromiter(counts[language].values(), float, len(words))
        prepared = [(weight[at], *lattice.ids([words[i] for i in at])) for at in blocks(words)]
        now = np.append(np.full(size, 1 / size), [UNKNOWN, 0])
        for _ in range(rounds):
            used = np.zeros(size + 2)
            for w, ids, lengths in prepared:
                used += expected(ids, lengths, now, w)
            total = used[:size].sum() + SMOOTH * size
            now = np.append((used[:size] + SMOOTH) / total, [UNKNOWN, 0])
        p[:, k] = now
    return Model(languages, vocabulary, p)


class Scorer:
    """Log likelihoods of texts, with the chunks between white space remembered."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, model.lattice()
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for at in blocks(words):
            ids, lengths = self.lattice.ids([words[i] for i in at])
            out[at] = forward(ids, lengths, self.model.p)
        return out

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.row]
        if not new:
            return
        split = [runs(c) for c in new]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        values = self.words(list(distinct)) if distinct else np.zeros((0, self.table.shape[1]))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        own = np.fromiter((distinct[w] for w in chain.from_iterable(split)), np.int64, int(sizes.sum()))
        rows = np.zeros((len(new), self.table.shape[1]))
        np.add.at(rows, np.repeat(np.arange(len(new)), sizes), values[own])
        start = len(self.table)
        self.row.update(zip(new, range(start, start + len(new)), strict=True))
        self.table, self.letters = np.concatenate([self.table, rows]), np.concatenate([self.letters, sizes > 0])

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [t.lower().split() if t else [] for t in texts]
        if len(self.row) > REMEMBERED:
            self.clear()
        self.learn(set().union(*split))
        out = []
        for chunks in split:
            at = np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))
            if not self.letters[at].any() or not self.model.languages:
                out.append(("und", 0.0))
                continue
            score = self.table[at].sum(axis=0)
            best = int(score.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(score - score[best]).sum())))
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, group in b.groupby("lang"):
                n: Counter[str] = Counter()
                for t in group["text"]:
                    n.update(runs(t.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(n), "n": list(n.values())})

    return docs.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lowest(ids: DataFrame, n: int) -> DataFrame:
    """The rows (doc_id, lang) among which are each language's ``n`` of the smallest hash; about twice as many, however many there are.

    Counted by how often the range of hashes must be halved to leave a hash out.
    """
    share = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    halved = ids.withColumn("level", F.least(F.coalesce(F.floor(-F.log2(share)), F.lit(63)), F.lit(63)).cast("int"))
    counted = halved.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("rows"))
    downward = Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = counted.withColumn("all", F.sum("rows").over(downward))
    least = enough.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("all") >= n, F.col("level"))), F.lit(0)).alias("least"))
    # a row a language
    return halved.join(F.broadcast(least), "lang").filter("level >= least").select("doc_id", "lang")


def train(labelled: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on documents (doc_id, text, lang); rows without text or lang teach nothing."""
    usable = labelled.filter("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = lowest(usable.select("doc_id", "lang"), sample_docs).withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= sample_docs)
    # at most sample_docs rows a language
    sample = usable.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in word_counts(sample).orderBy("lang", "word").toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    for (lang,) in chosen.select("lang").distinct().collect():
        counts.setdefault(lang, {})
    return fit({k: v for k, v in counts.items() if v}, pieces(vocabulary or default_vocabulary()))


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", row: str | None = None) -> DataFrame:
    """All columns of ``docs`` but its text, with lang_pred and score; only the text is looked at.

    lang_pred is ``und`` with score 0 where the text is null or has no letter; otherwise the
    likeliest language (ties: the first by code point) and its share of the likelihood. With
    ``row`` the text is that field of this struct column, which is kept.
    """
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 256):
                part = b.slice(at, 256)
                own = part.column(row).field(text) if row else part.column(part.num_columns - 1)
                said = scorer.texts(own.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if row else [F.col(f"`{text}`").cast("string").alias(text)]))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[: len(keep)], *added]))


def recognised(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose text has letters and a language with a score of ``least`` or more."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return predict(spark, rows, model, row="row").filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id's text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def language_id(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document; learns from those not held out.

    A null doc_id is not held out for learning's sake either: it has no remainder, so it
    teaches nothing and held_out is false. Without a labelled row every text is ``und``.
    Repeated rows are scored alike; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.filter(~held_out()), vocabulary)
    marked = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(docs.sparkSession, marked, model)
