"""Byte-level BPE encoding through a lexicon of frequent words, and decoding.

The pieces that the vocabulary's pre-tokeniser cuts (called words) are counted over all
documents. The most frequent ones are encoded once and compiled into a minimal acyclic
transducer with id outputs (see ``lexicon``), which workers map into memory. A batch
looks its distinct words up together; words that the lexicon does not hold are merged
by the vocabulary's own merge model, so ids never depend on what is in the lexicon.
A decoder maps ids to bytes and bytes to text.

The lexicon holds at most ``LEXICON_WORDS`` words of at most ``WORD_BYTES`` bytes, those
of a whole class of similar counts or none, which bounds the file and what the driver
sees. Nothing else of the corpus reaches the driver.

Defined cases: a null text counts as empty and has no ids; a null doc_id is kept; every
row gives a row, repeated ones too; a text that holds a special token's string goes
through the whole tokenizer, which gives that token's id; further columns are ignored;
an empty table gives no rows; a text of any length is one row. Bytes that are no UTF-8
after decoding become the replacement character. An id that the vocabulary lacks
decodes to nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import lexicon
from tidewatch.llm.common import as_batch, column, map_batches, text_list, texts_of
from tidewatch.llm.tokens import byte_letters
from tidewatch.session import materialize

LEXICON_WORDS = 1 << 16
WORD_BYTES = 64
# Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
# Counts of one class differ by less than a CLASSES-th of a doubling.
CLASSES = 16
# Letters that no Unicode version disputes; texts with other characters beyond ASCII are
# cut by the library's pre-tokeniser.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\t\n\r -~{_LETTERS}]*")
# Fixed value: how byte-level vocabularies cut words (public pattern).
_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


class Vocabulary:
    """One byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        cut = rules["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if rules["normalizer"] or not plain or (rules["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in rules["added_tokens"]]
        letters = byte_letters()
        self.letter_of = dict(enumerate(letters))
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.bytes_of = {
            number: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items()
        }

    def words(self, text: str) -> list[str] | None:
        """The text's words; None where only the whole tokenizer gives its ids."""
        if any(token in text for token in self.special):
            return None
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, word: str) -> list[int]:
        spelt = word.encode().decode("latin-1").translate(self.letter_of)
        return [t.id for t in self.tokenizer.model.tokenize(spelt)]

    def text(self, ids: np.ndarray) -> str:
        pieces = [self.bytes_of.get(i, b"") for i in ids.tolist()]
        return b"".join(pieces).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per file and worker process."""
    return Vocabulary(path)


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n over all documents. Tasks add up before anything is shuffled."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path).words
        held: Counter[str] = Counter()
        for batch in batches:
            for text in text_list(batch):
                held.update(words(text) or ())
            if len(held) > HELD_WORDS:
                yield as_batch({"word": list(held), "n": list(held.values())}, schema)
                held.clear()
        yield as_batch({"word": list(held), "n": list(held.values())}, schema)

    counted = texts_of(docs).select("text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words, whole classes of counts, at most ``limit``."""
    fit = counts.where((F.col("n") > 1) & (F.octet_length("word") <= WORD_BYTES)).withColumn(
        "class", F.floor(F.log2("n") * CLASSES))
    fit = materialize(fit, "frequent-words")
    total, lowest = 0, None
    for row in sorted(fit.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        total += row["count"]
        if total > limit:
            break
        lowest = row["class"]
    if lowest is None:
        return []
    return [row["word"] for row in fit.where(F.col("class") >= lowest).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> str:
    """Count, compile and publish; the name under which workers find the lexicon."""
    merged = vocabulary(path).merged
    words = frequent_words(word_counts(docs, path), limit)
    return lexicon.publish(docs.sparkSession, lexicon.compiled({w.encode(): merged(w) for w in words}))


def batch_encoder(path: str, name: str) -> Callable[[list[str]], list[bytes]]:
    known, words_of = lexicon.mapped(name), vocabulary(path)

    def encode(texts: list[str]) -> list[bytes]:
        cut = [words_of.words(text) for text in texts]
        words = list(set(chain.from_iterable(w for w in cut if w)))
        places = known.places([w.encode() for w in words]).tolist()
        ids = {
            word: known.id_bytes(place) if place >= 0 else np.asarray(words_of.merged(word), "<u4").tobytes()
            for word, place in zip(words, places, strict=True)
        }
        return [
            words_of.whole(text) if w is None else b"".join(map(ids.__getitem__, w))
            for text, w in zip(texts, cut, strict=True)
        ]

    return encode


def encode(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers)."""
    name = build_lexicon(docs, path, limit)

    def make():
        step = batch_encoder(path, name)
        return lambda batch: {"doc_id": column(batch, "doc_id"), "ids": step(text_list(batch))}

    return map_batches(texts_of(docs), "doc_id long, ids binary", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of rows with doc_id and ids."""
    def make():
        text = vocabulary(path).text

        def step(batch: pa.RecordBatch) -> dict:
            ids = column(batch, "ids")
            return {
                "doc_id": column(batch, "doc_id"), "ids": ids,
                "text": [text(np.frombuffer(i, "<u4")) for i in ids.to_pylist()],
            }

        return step

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, ids binary, text string", make)


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
