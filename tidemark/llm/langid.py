"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. For each language, EM learns a probability for every piece from
that language's word counts: the forward and backward sums over all ways to cut a word into pieces
give the expected uses of each piece. A text's likelihood is the product over its words of the forward
sum, so no single segmentation is chosen. The prediction is the language of the highest posterior
(with the training share as prior); the score is that posterior.

Words are separated by white space and common punctuation and lower-cased, with the vocabulary's word mark in front. Characters
outside the vocabulary are single unknown pieces. Words of up to ``SHORT`` characters are summed many at a time; longer ones, however
long, one at a time with a rescaled sum that looks back as far as the longest piece, so the cost of a character is bounded.

EM ends when a round raises the mean log-likelihood of a word by less than ``GAIN``, or after ``rounds``.

What is learned grows with the corpus: word counts of all training rows, combined per Arrow batch before
the shuffle. Only (piece, language) sums reach the driver: vocabulary size times languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language do not
train; with no training rows at all every text is ``und``; ties go to the first language by name; repeated
rows are predicted alike; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.worker import held
from tidemark.runtime import materialize, ship

MARK = "▁"
SHORT = 24
GAIN = 0.15
MEMO_BYTES = 80 << 20
ENTRY_BYTES = 130  # of a word's place in the memo, besides the word itself and its scores
PUNCTUATION = ".,!?;:\"|()"
UND = "und"
PIECE_CHARS = 1 << 20


def vocabulary_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model: no control, unknown or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return sorted({model.id_to_piece(i).lower() for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))})


def words_of(text: str) -> list[str]:
    """Words; common punctuation is no part of one."""
    text = text.lower()
    for c in PUNCTUATION:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


class Lattice:
    """Forward and backward sums over the segmentations of many words of one length at a time.

    Row ``V`` of a probability table is the unknown character. Pieces are found by 64-bit hashes of all
    substrings at once: a polynomial over code points, looked up in two open tables.
    """

    BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
    SLOT_BITS = 20

    def __init__(self, pieces: list[str]):
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SHORT + 2, self.BASE)]), dtype=np.uint64)
        self.hashes = np.zeros(len(pieces) + 2, dtype=np.uint64)
        for i, p in enumerate(pieces):
            self.hashes[i] = self._prefixes(self._codes([p]))[0, -1]
        self.tables = [np.full(1 << self.SLOT_BITS, self.none, dtype=np.int32) for _ in self.SPREAD]
        rest = np.arange(len(pieces), dtype=np.int32)
        for table, spread in zip(self.tables, self.SPREAD, strict=True):
            slots = (self.hashes[rest] * spread) >> np.uint64(64 - self.SLOT_BITS)
            table[slots] = rest
            rest = rest[table[slots] != rest]  # these lost their slot: next table
        self.crowded = {int(self.hashes[i]): int(i) for i in rest}

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.asarray(words, dtype=f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        mixed = (codes + np.uint64(1)) * self.SPREAD[1]
        mixed ^= mixed >> np.uint64(31)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * self.BASE + mixed[:, k]
        return out

    def spans(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces): which of the words have which piece at a place. All words have one length; every
        word has a piece, or the unknown one, at each single character."""
        n, prefixes, out = len(words[0]), self._prefixes(self._codes(words)).T.copy(), []
        shift = np.uint64(64 - self.SLOT_BITS)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                h = prefixes[j] - prefixes[i] * self.powers[j - i]
                ids = self.tables[0][(h * self.SPREAD[0]) >> shift]
                ids[self.hashes[ids] != h] = self.none
                second = self.tables[1][(h * self.SPREAD[1]) >> shift]
                at = np.flatnonzero(self.hashes[second] == h)
                if len(at):
                    ids[at] = np.where(second[at] != self.none, second[at], ids[at])
                for known, piece in self.crowded.items():
                    ids[h == np.uint64(known)] = piece
                if j == i + 1:
                    ids[ids == self.none] = self.unknown
                    out.append((i, j, np.arange(len(words)), ids))
                    continue
                rows = np.flatnonzero(ids != self.none)
                if len(rows):
                    out.append((i, j, rows, ids[rows]))
        return out

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Sums for every language: rows of words, columns of ``table``."""
        alpha = [np.ones((len(words), table.shape[1]))] + [np.zeros((len(words), table.shape[1])) for _ in words[0]]
        for i, j, rows, ids in self.spans(words):  # by rising end: alpha[i] is complete
            alpha[j][rows] += alpha[i][rows] * table[ids]
        return alpha[-1]

    def spans_of(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end (from 1), the (begin, piece) of the pieces that end there, in a word of any length."""
        number, longest = self.number.get, self.longest
        out = []
        for j in range(1, len(word) + 1):
            here = [(i, p) for i in range(max(0, j - longest), j - 1) if (p := number(word[i:j])) is not None]
            out.append([*here, (j - 1, number(word[j - 1], self.unknown))])
        return out

    def log_forward(self, word: str, table: np.ndarray) -> np.ndarray:
        """The logarithm of the sum for every language, of one word of any length: rescaled at every character."""
        back = [np.ones(table.shape[1])]  # sums up to the last characters, all in one scale
        scale = np.zeros(table.shape[1])
        for j, spans in enumerate(self.spans_of(word), 1):
            total = np.zeros(table.shape[1])
            for i, piece in spans:
                total += back[i - j] * table[piece]
            factor = np.maximum(total, 1e-300)
            back = [x / factor for x in back[-self.longest + 1 :]] + [total / factor]
            scale += np.log(factor)
        return scale

    def long_expected(self, word: str, language: int, weight: float, table: np.ndarray) -> tuple[list[int], list[float], float]:
        """(flat keys, expected uses, log-likelihood) of one word of any length, with the sums rescaled at every character."""
        spans, width, flat = self.spans_of(word), table.shape[1], table.reshape(-1)
        alpha, factors = [1.0], []  # alpha[i] times the product of the factors up to i is the sum
        for j, here in enumerate(spans, 1):
            total = 0.0
            for i, piece in here:
                total += alpha[i] * float(flat[piece * width + language]) / math.prod(factors[i:])
            factors.append(max(total, 1e-300))
            alpha.append(total / factors[-1])
        beta, keys, uses = [0.0] * len(word) + [1.0], [], []
        for j in range(len(word), 0, -1):
            for i, piece in spans[j - 1]:
                through = float(flat[piece * width + language]) * beta[j] / math.prod(factors[i:j])
                beta[i] += through
                keys.append(piece * width + language)
                uses.append(weight * alpha[i] * through)
        return keys, uses, weight * sum(map(math.log, factors))

    def expected(self, words: list[str], language: np.ndarray, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(flat piece * languages + language, expected uses), and the log-likelihood, of words that each belong to one language."""
        n, spans, width = len(words[0]), self.spans(words), table.shape[1]
        flat = table.reshape(-1)
        keys = [ids.astype(np.int64) * width + language[rows] for _, _, rows, ids in spans]
        p = [flat[k] for k in keys]
        alpha = [np.ones(len(words))] + [np.zeros(len(words)) for _ in range(n)]
        for (i, j, rows, _), q in zip(spans, p, strict=True):
            alpha[j][rows] += alpha[i][rows] * q
        beta = [np.zeros(len(words)) for _ in range(n)] + [weight / alpha[n]]
        uses = []
        for (i, j, rows, _), q in zip(reversed(spans), reversed(p), strict=True):  # by falling end: beta[j] is complete
            through = q * beta[j][rows]
            beta[i][rows] += through
            uses.append(alpha[i][rows] * through)
        uses.reverse()
        return np.concatenate(keys), np.concatenate(uses), float(weight @ np.log(np.maximum(alpha[n], 1e-300)))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    table: np.ndarray  # probabilities, (pieces + 2) x languages
    log_prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        memo = held(("language", self.key), lambda: Memo(self))
        piece: list[str | None] = []
        size = 0
        for text in texts:
            piece.append(text)
            size += len(text or "")
            if size > PIECE_CHARS:
                yield from self._predict(piece, memo)
                piece, size = [], 0
        yield from self._predict(piece, memo)

    def _predict(self, texts: list[str | None], memo: Memo) -> Iterator[tuple[str, float]]:
        split = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        memo.learn({w for words in split for w in words})
        place = memo.known.__getitem__
        for words in split:
            if not words or not self.languages:
                yield UND, 0.0
                continue
            total = memo.scores[np.fromiter(map(place, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64) + self.log_prior
            best = int(total.argmax())
            yield self.languages[best], float(1 / np.exp(total - total[best]).sum())
        memo.forget()


class Memo:
    """A worker's scores of words under one model, bounded in bytes: once full, new words are forgotten again."""

    def __init__(self, model: LanguageModel):
        self.table, self.lattice = model.table, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, model.table.shape[1]), dtype=np.float32)
        self.size = self.before = 0

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        self.before = at = len(self.known)
        if at + len(new) > len(self.scores):
            more = np.zeros((at + len(new) + len(self.scores) // 4, self.scores.shape[1]), dtype=np.float32)
            more[:at] = self.scores[:at]
            self.scores = more
        for part in by_length(w for w in new if len(w) < SHORT):
            self.scores[at : at + len(part)] = np.log(np.maximum(self.lattice.forward([MARK + w for w in part], self.table), 1e-300))
            self.known.update(zip(part, range(at, at + len(part)), strict=True))
            at += len(part)
        for w in new:
            if len(w) >= SHORT:
                self.scores[at] = self.lattice.log_forward(MARK + w, self.table)
                self.known[w] = at
                at += 1
        self.size += sum(map(self._bytes, new))

    def _bytes(self, word: str) -> int:
        return ENTRY_BYTES + sys.getsizeof(word) + 4 * self.scores.shape[1]

    def forget(self) -> None:
        while self.size > MEMO_BYTES and len(self.known) > self.before:  # what came last goes: the early words are the frequent ones
            self.size -= self._bytes(self.known.popitem()[0])


def by_length(words: Iterable[str], most: int = 4_000) -> Iterator[list[str]]:
    """Words of equal length, some at a time."""
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for group in groups.values():
        for at in range(0, len(group), most):
            yield group[at : at + most]


def word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[language].update(words_of(body))
            for language, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(lattice: Lattice, rows: Iterable[tuple[int, str, int]], table: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected uses by flat key, log-likelihood) of (language, word, count) rows under ``table``."""
    sums, likelihood = np.zeros(table.size), 0.0
    groups: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
    for language, word, n in rows:
        if len(word) < SHORT:
            groups[len(word)].append((MARK + word, language, n))
        else:
            keys, uses, gain = lattice.long_expected(MARK + word, language, n, table)
            np.add.at(sums, keys, uses)
            likelihood += gain
    for group in groups.values():
        for at in range(0, len(group), 4_000):
            words, which, weight = zip(*group[at : at + 4_000], strict=True)
            keys, uses, gain = lattice.expected(list(words), np.asarray(which), np.asarray(weight, dtype=float), table)
            sums += np.bincount(keys, weights=uses, minlength=table.size)
            likelihood += gain
    return sums, likelihood


def train(df: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", rounds: int = 8, gain: float = GAIN, smoothing: float = 0.1) -> LanguageModel:
    """Piece probabilities by EM over the word counts of all rows of ``df`` that have a language."""
    ship(df.sparkSession)
    pieces = vocabulary_pieces(vocabulary)
    shares = {r["lang"]: r["n"] for r in df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    width, number = len(languages), {x: i for i, x in enumerate(languages)}
    table = np.full((len(pieces) + 2, width), 1.0 / (len(pieces) + 1))
    table[-1] = 0.0
    if not languages:
        return LanguageModel([], pieces, table, np.zeros(0))
    counts = materialize(word_counts(df, text, lang), "word-counts")
    words = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    key, before = uuid.uuid4().hex, -math.inf
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            lattice = held(("lattice", key), lambda: Lattice(pieces))
            sums, likelihood = np.zeros(table.size), 0.0
            for batch in batches:
                some, part = expected_uses(lattice, ((number[x], w, n) for x, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), table)
                sums += some
                likelihood += part
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([likelihood, *sums[at].tolist()], pa.float64())], ["key", "uses"])

        learned, now = np.zeros(table.size), 0.0
        for r in counts.mapInArrow(expect, "key long, uses double").groupBy("key").agg(F.sum("uses").alias("uses")).collect():
            if r["key"] < 0:
                now = r["uses"] / words
            else:
                learned[r["key"]] = r["uses"]
        learned = learned.reshape(table.shape) + smoothing
        learned[-1] = 0.0
        table = learned / learned.sum(axis=0)
        if now - before < gain:
            break
        before = now
    total = sum(shares.values())
    return LanguageModel(languages, pieces, table, np.asarray([math.log(shares[x] / total) for x in languages]))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    ship(df.sparkSession)
    kept = df.drop(lang_pred, score)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.predict(t.as_py() for t in batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, lang_pred, score])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One third of the documents, by a checksum of the id: never trained on."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def document_languages(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Contract rows: trained on the documents that are not held out, predicted for all from the text alone."""
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), vocabulary)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
