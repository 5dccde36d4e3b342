from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES
from tidewatch.llm import bpe, lexicon

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    (1, "It's we'll they'd 'tis 'S don't"), (2, "a  b   c \n\n d\t\te "), (3, "x²³ ½ 123abc 4.5€ ª º ×÷"),
    (4, "中文字符 русский текст ελληνικά 🙂🙂 ​ \u0085\x1c\x1f end"), (5, "a<|endoftext|>b <|endoftext|>"),
    (6, "\x00\x01 null"), (7, "ab" * 4000), (8, "Ünïcode straße façade naïve œuvre"), (9, "é ﬁ ǅ"),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows):
    out = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        raw = np.asarray(ids, "<u4").tobytes()
        out[(doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limit", [0, 40, bpe.LEXICON_WORDS])
def test_round_trip_equals_the_library(make_docs, corpus, tokenizer, limit):
    rows = corpus + ODD + [(20 + i, "The tide of the market. The tide, the river") for i in range(5)]
    encoded = bpe.encode(make_docs(rows), PATH, limit)
    got = Counter(tuple(r) for r in bpe.digest(bpe.decode(encoded, PATH)).collect())
    assert got == expected(tokenizer, rows)


def test_empty_table(make_docs):
    assert bpe.decode(bpe.encode(make_docs([]), PATH), PATH).count() == 0


def test_any_ids_decode_like_the_library(llm, tokenizer):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(50257) for _ in range(30)]) for i in range(40)] + [(50, [50256, 99, 50256])]
    frame = llm.createDataFrame([(i, bytearray(np.asarray(v, "<u4").tobytes())) for i, v in rows], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(frame, PATH).collect()}
    assert got == {i: tokenizer.decode(v, skip_special_tokens=False) for i, v in rows}


def test_word_counts_cover_every_text(make_docs, corpus):
    cut = bpe.vocabulary(PATH).words
    want = Counter()
    for _, text in corpus:
        want.update(cut(text or ""))
    assert {r.word: r.n for r in bpe.word_counts(make_docs(corpus), PATH).collect()} == dict(want)


def test_lexicon_is_minimal_and_exact():
    rnd = random.Random(9)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 7))) for _ in range(500)} | {b"\xff\x00", b"z" * 60}
    entries = {w: [rnd.randrange(50000) for _ in range(rnd.randint(1, 4))] for w in words}
    reader = lexicon.Lexicon(lexicon.compiled(entries))
    asked = sorted(words) + [b"", b"abcabcabc", b"zz", b"\xff", b"q"]
    places = reader.places(asked).tolist()
    assert places == [*range(len(words)), *(-1 if w not in words else None for w in asked[len(words):])]
    for word, place in zip(sorted(words), places, strict=False):
        assert np.frombuffer(reader.id_bytes(place), "<u4").tolist() == entries[word]
    # one state per set of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(reader.accepts) == len(endings)


def test_lexicon_of_nothing():
    assert lexicon.Lexicon(lexicon.compiled({})).places([b"a", b""]).tolist() == [-1, -1]


def test_frequent_words_take_whole_classes(llm):
    counts = llm.createDataFrame([("a", 100), ("b", 100), ("c", 50), ("d", 1), ("e" * 65, 900)], "word string, n long")
    assert sorted(bpe.frequent_words(counts, 3)) == ["a", "b", "c"]
    assert sorted(bpe.frequent_words(counts, 2)) == ["a", "b"]
    assert bpe.frequent_words(counts, 1) == []
