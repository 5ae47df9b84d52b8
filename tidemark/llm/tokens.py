"""Tokenizing whole texts with a public tokenizer file, with a memo of words.

Byte-level BPE never merges across the pieces of its splitting pattern, and in that pattern a piece
always begins at a single space after a character that is not white space, and after a line break that
has no white space on either side. So a text falls into words there, and the ids of the text are the ids
of its words, joined. A worker encodes each new word once with the ``tokenizers`` library
and looks the others up. A text in which white space meets white space is encoded as a whole.

The memo is bounded in bytes (``MEMO_BYTES``): once full, new words are forgotten again. A worker keeps one memo at a time, whatever operators it serves (``worker.py``). Results never
depend on it. Words are cut only if the file's splitting pattern is that of byte-level BPE without a normaliser; with any
other tokenizer every text is encoded as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np

from tidemark.llm.worker import held

MEMO_BYTES = 64 << 20
ENTRY_BYTES = 220  # of a word, its ids and their place in the dictionary, besides their characters
MARKS = ".,!?;:\"()[]{}*&#$%|<>-_/+=~^@\\"  # ASCII marks; not the apostrophe, which may begin a contraction
#: The simple cuts do not hold where white space meets white space or a text's end, nor for other white
#: space than the space and the line break. Each of these is a plain substring search.
_IRREGULAR = ["  ", " \n", "\n ", "\n\n", "\0", *(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n")]


def _regular(text: str) -> bool:
    return text[0] not in " \n" and text[-1] not in " \n" and not any(s in text for s in _IRREGULAR)


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as one printable character: printable Latin-1 ones as they are, the
    others in order from code point 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """The ids of words, as bytes; a new word is encoded when it is looked up."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.tokenize, self.names = tokenizer.model.tokenize, _byte_names()
        self.space = self.names[0x20]
        self.pairs = [i.to_bytes(2, "little") for i in range(tokenizer.get_vocab_size())]
        self.size = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        bare = word.rstrip(MARKS)
        if len(bare) < len(word) and bare[-1:].isalnum():
            # Marks after a letter or digit are a piece of their own.
            ids = self[bare] + self[word[len(bare) :]]
        elif word.isalpha() or (word[:1] == " " and word[1:].isalpha()):
            # A word of letters alone is one piece: it goes to the merges directly, past the splitting pattern.
            spelt = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.names)
            pair = self.pairs
            ids = b"".join([pair[t.id] for t in self.tokenize(spelt)])
        else:
            ids = self.whole(word) if word else b""
        self[word] = ids
        self.size += ENTRY_BYTES + 2 * len(word)
        return ids


class Memo:
    """Encodes texts to little-endian bytes of unsigned 16-bit ids (vocabularies up to 65,536)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("16-bit ids need a vocabulary of at most 65,536 entries")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = self._splits_at_spaces(path)
        self.words = Words(self.tokenizer)

    @staticmethod
    def _splits_at_spaces(path: str) -> bool:
        """Whether the file's pieces are those that the cuts rely on: plain byte-level BPE, and nothing done to the text before."""
        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        return bool(plain and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for text in texts:
            yield self._encode(text)

    def _encode(self, text: str) -> bytes:
        if not text or not self.by_words or not _regular(text) or any(s in text for s in self.special):
            return self.words.whole(text) if text else b""
        before = len(self.words)
        # A leading space belongs to its word; the line break is a piece of its own.
        ids = b"".join(map(self.words.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
        while self.words.size > MEMO_BYTES and len(self.words) > before:  # what came last goes: the early words are the frequent ones
            self.words.size -= ENTRY_BYTES + 2 * len(self.words.popitem()[0])
        return ids


def memo(path: str) -> Memo:
    """The worker's memo for this file, until the worker needs its memory for another operator."""

    def make() -> Memo:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Memo(path)

    return held(("tokens", path), make)


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in short stretches: what Python holds of a batch at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
