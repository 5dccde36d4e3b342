from __future__ import annotations

import random
import zlib

import pytest

from tidewatch.llm.common import prepare

WORDS = "the of tide stone river market glass winter path signal lemon orbit".split() + [f"w{i:03d}x" for i in range(400)]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def make_docs(llm):
    """documents-like frame with clashing extra columns."""
    def make(rows):
        return llm.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), 7, 0.5) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, score long, length double",
        ).repartition(3)

    return make


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


EDGES = [
    (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (904, "one"), (905, "Ünïcode ßtraße 中文 🙂"),
    (None, "a row without an id"), (906, "  two  blanks \n and  more \t "), (907, "x" * 5000),
]


@pytest.fixture(scope="session")
def corpus():
    rnd = random.Random(11)
    rows = [(i, prose(rnd, rnd.choice([3, 8, 60, 200]))) for i in range(60)]
    rows.append((60, prose(rnd, 9000)))
    return rows + EDGES


def fold(doc_id, modulus, rest):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus == rest
