from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import collocations, counting_filter


def brute(rows, least=10, share=50, top=2000):
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = set()
    for lang, seen in counts.items():
        n = sum(f for g, f in seen.items() if len(g) == 1)
        often = {g: f for g, f in seen.items() if len(g) > 1 and f >= least}
        found = []
        for g, a in often.items():
            score, k = min(((10**6 * a * a) // (seen[g[:k]] * seen[g[k:]]), k) for k in range(1, len(g)))
            longer = [f for h, f in often.items() if len(h) > len(g) and g in (h[:2], h[1:])]
            if not any(100 * f >= share * a for f in longer):
                found.append((-score, -a, " ".join(g).encode(), seen[g[:k]], seen[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def frame(llm, rows):
    return llm.createDataFrame(
        [(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)],
        "doc_id long, text string, lang string, n long, phrase string").repartition(4)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["Über", "中文", "A'B"]
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", " ", ". ", "\n", ","]) for _ in range(60))
        text += rnd.choice(["New York City", "new york city!", "ping pong ball", "ping pong", "a a a a"])
        rows.append((rnd.choice(["en", "de", None, ""]), text))
    return rows + [("en", None), ("en", ""), ("en", " .,; "), ("fr", "seul"), ("en", "tic tac toe " * 3000)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_words": 300, "task_keys": 500, "slice_keys": 64}])
def test_collocations_against_plain_counting(llm, rows, sizes):
    got = collocations.mine(frame(llm, rows), **sizes).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_each_lang_has_its_own_first_rows(llm, rows):
    got = {tuple(r) for r in collocations.mine(frame(llm, rows), top=5).collect()}
    assert got == brute(rows, top=5)


def test_without_phrases(llm):
    assert collocations.mine(frame(llm, [])).count() == 0
    assert collocations.mine(frame(llm, [("en", "one two three"), ("en", None)])).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 17, 21, 22, 33, 40])
def test_filters_keep_every_count(bits):
    rng = np.random.default_rng(bits)
    space = counting_filter.Keys(bits)
    grams = rng.integers(0, 1 << bits, size=(3000, 3), dtype=np.uint64)
    grams[1500:] = grams[:1500]  # repeats
    keys = space.pack(*grams.T)
    assert (np.array(space.unpack(keys)).T == grams).all()
    weights = rng.choice([1, 2, 255, 256, 257, 10**12], size=3000).astype(np.int64)
    want = Counter()
    for gram, weight in zip(map(tuple, grams.tolist()), weights.tolist(), strict=True):
        want[gram] += weight
    parts = []
    for at in range(0, 3000, 700):  # shards of different sizes, cut into slices, stored and loaded
        sorted_keys, counts = counting_filter.merge([(keys[at:at + 700], weights[at:at + 700])])
        for cut in (0, min(3, space.width)):
            loaded = [counting_filter.loaded(f) for _, f in counting_filter.slices(space, sorted_keys, counts, cut)]
            assert (np.concatenate([k for _, k, _ in loaded]) == sorted_keys).all()
            assert np.concatenate([c for _, _, c in loaded]).tolist() == counts.tolist()
        parts += [(k, c) for _, k, c in loaded]
    merged, counts = counting_filter.merge(parts)
    got = {tuple(int(x) for x in gram): int(c) for *gram, c in zip(*space.unpack(merged), counts, strict=True)}
    assert got == dict(want)


def test_empty_filter():
    space = counting_filter.Keys(9)
    none = np.zeros(0, dtype=np.uint64)
    data = counting_filter.stored(space, none, none.astype(np.int64), 2, 1)
    assert len(counting_filter.loaded(data)[1]) == 0
