"""Token ids of whole texts, with each distinct word encoded once per worker.

The public tokenizers cut a text at every single blank that stands before or after
something that is not white space, so the ids of a text are the ids of its pieces in
a row. Pieces repeat; their ids are kept as packed bytes. Pieces of plain characters
are cut into words here, which go to the tokenizer's merge model; all others, and
texts in which a blank lies inside a run of white space, go through the whole
tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
import regex

# A worker keeps two generations of pieces of at most so many characters each (with
# PIECE_COST for the entry itself); the older one goes when the younger is full.
CACHE_CHARS = 30_000_000
PIECE_COST = 40
CACHE_WORDS = 500_000
# Characters whose class and case no Unicode version disputes.
_PLAIN = re.compile("[\n!-~¡-ɏ]+")
_SPECIAL = "<|"
# How the two kinds of vocabularies cut words (public patterns).
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> str:
    """The letters that byte-level vocabularies write for bytes 0 to 255: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


def _four_bytes(*ids: int) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class _WholeText(Exception):
    """A piece starts with white space or is empty: its cut is not one of the tokenizer's."""


class _Words(dict):
    """Ids of words, by word."""

    def __init__(self, model) -> None:
        self.tokenize = model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[0x20]

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha():
            spelt = self.blank + word[1:] if word[0] == " " else word
        else:
            spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = _four_bytes(*[t.id for t in self.tokenize(spelt)])
        return ids


class _Pieces(dict):
    """Ids of pieces with the blank before them."""

    def __init__(self, owner: PieceEncoder, older: dict[str, bytes]) -> None:
        self.owner, self.older, self.held = owner, older, 0

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _WholeText
        ids = self[piece] = self.older.get(piece) or self.owner.piece(piece)
        self.held += len(piece) + PIECE_COST
        return ids


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            lower = "Lowercase" in json.dumps(json.load(file)["normalizer"] or {})
        self.fold = str.lower if lower else str
        self.blank = "" if lower else " "
        self.cut = regex.compile(_LOWER_WORDS if lower else _BYTE_WORDS).findall
        self.words = _Words(self.tokenizer.model)
        self.pieces = _Pieces(self, {})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        folded = self.fold(piece)
        mark = folded[-1]
        core = folded[:-1] if mark in ".," else folded
        if core.isascii() and core.isalpha():  # most pieces: one word, perhaps a mark
            ids = self.words[self.blank + core]
            return ids + self.words[mark] if mark in ".," else ids
        if _PLAIN.fullmatch(folded) and _SPECIAL not in piece:
            return b"".join(map(self.words.__getitem__, self.cut(" " + folded)))
        return self.whole(" " + piece)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if self.pieces.held > CACHE_CHARS:
            self.pieces = _Pieces(self, dict(self.pieces))
        if len(self.words) > CACHE_WORDS:
            self.words = _Words(self.tokenizer.model)
        try:
            return b"".join([self.whole(first) if first else b"", *map(self.pieces.__getitem__, rest)])
        except _WholeText:
            return self.whole(text)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per file and worker process; workers serve many tasks."""
    return PieceEncoder(path)
