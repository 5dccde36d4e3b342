from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import fold, prose
from tidewatch.llm import decontamination, lm, ngram_join, topk
from tidewatch.llm.common import words_of
from tidewatch.llm.components import components


def brute_top(rows, k):
    def use(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and use(v)]
    want = set()
    for q in {i for i, _ in kept if i % 50 == 0}:
        for qv in {tuple(v) for i, v in kept if i == q}:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in kept if i != q)
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return want


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(llm, scale):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, scale) for _ in range(40)]) for i in range(260)]
    rows += [(i, rows[3][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [2.0]), (None, [1.0])]
    rows += [(406, [rnd.random() for _ in range(90)])]
    rows += [rows[50], rows[50]]  # a query that is stored three times asks once
    df = llm.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, candidate_block=32, query_block=3).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_top_k_broadcasts_nothing(llm):
    """Few queries look small to the planner, but they are sent to every block."""
    df = llm.range(400).selectExpr("id AS vec_id", "array(cast(id AS float), 1.0F) AS embedding")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, candidate_block=8)
    assert found.count() == 8 * 5
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_parts_of_a_block_give_what_the_block_gives(scale):
    rnd = np.random.default_rng(4)
    block = np.floor(rnd.normal(size=(40, 300)) * 256 * scale).astype(np.int64)
    block[:, 100:140] = block[:, [3]]
    ids, asked = rnd.permutation(300), block[:, 90:110]
    whole = [(q, list(i), [int(v) for v in s]) for q, i, s in topk.best_of_block(ids[90:110], asked, ids, block, 5)]
    parts = [(ids[i : i + 11], block[:, i : i + 11]) for i in range(0, 300, 11)]
    assert list(topk.best_of_parts(ids[90:110], asked, parts, 5)) == whole


def test_top_k_of_little(llm):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(llm.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = llm.createDataFrame([(0, [1.0]), (1, [1.0])], schema)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 65536)]


def near(rnd, words, share):
    return [w if rnd.random() > share else prose(rnd, 1) for w in words]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(5)
    rows, number = [], 0
    for size in (1, 4, 8, 40, 90):
        for _ in range(6):
            words = prose(rnd, size).split()
            for share in (0, 0, 0.01, 0.02, 0.05, 0.1):
                rows.append((number, " ".join(near(rnd, words, share))))
                number += 1
    base = prose(rnd, 60).split()
    rows += [(1000 + i, " ".join(near(rnd, base, 0.02))) for i in range(90)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "Same WORDS here"), (2004, "same words\there"), (2004, "same words here"),
             (2005, prose(rnd, 20)), (2005, prose(rnd, 25)), (None, "a text without id and some words"),
             (None, "a text without id and some words"), (2006, "é É"), (2007, "é é")]
    return rows


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = words_of(text or "")
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], math.inf if doc_id is None else doc_id)
    value = [least[find(i)] for i in range(len(rows))]
    return Counter((r[0], len(s), None if v == math.inf else v) for r, s, v in zip(rows, sets, value, strict=True))


@pytest.mark.parametrize("block", [256, 8])
def test_ngram_join(make_docs, copies, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = ngram_join.join(make_docs(copies)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_links(copies)


def test_ngram_join_of_nothing(make_docs):
    assert ngram_join.join(make_docs([])).count() == 0


def test_trees_lose_no_link():
    rnd = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rnd.integers(0, 2**63, rnd.integers(5, 300)).astype(np.uint64)
        for share in (0, 0.05, 0.1, 0.2):
            extra = rnd.integers(0, 2**63, int(len(base) * share)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[rnd.random(len(base)) > share / 2], extra, base[:1]])))
    half = len(sets) // 2 + 1
    a, b = ngram_join.Tree(sets[:half]), ngram_join.Tree(sets[half:])
    groups, want = ngram_join.Groups(list(range(len(sets)))), ngram_join.Groups(list(range(len(sets))))
    for tree, other, x, y in ((a, a, 0, 0), (b, b, half, half), (a, b, 0, half)):
        list(ngram_join.dual_walk(tree, other, groups, x, y))
    for i in range(len(sets)):
        for j in range(i):
            if want.find(i) != want.find(j) and ngram_join.linked(sets[i], sets[j]):
                want.join(i, j)
    assert groups.left == want.left < len(sets)
    assert all((groups.find(i) == groups.find(j)) == (want.find(i) == want.find(j)) for i in range(len(sets)) for j in range(i))


def test_components(llm):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (5, 7), (2, 200), (200, 201)]
    got = {r.vertex: r.label for r in components(llm.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 7: 3, 200: 2, 201: 2}


def test_decontamination(llm, make_docs, corpus):
    rnd = random.Random(8)
    items = [(i, prose(rnd, n) + ". " + prose(rnd, 5)) for i, n in enumerate([10, 25, 60, 80, 14])]
    items += [(50, None), (51, ""), (52, "only three words"), (53, "zebrawordalone"), (53, "zebrawordalone"), (None, prose(rnd, 12))]
    frame = llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, bm25_share int")
    docs = list(corpus)
    for number, (item, text) in enumerate(items):
        if text and item != 53:
            docs.append((3000 + number, prose(rnd, 300) + " " + text.upper() + " " + prose(rnd, 150)))
            words = text.split()
            docs.append((4000 + number, prose(rnd, 100) + " " + " ".join(words[: len(words) // 2]) + " " + prose(rnd, 9)))
    docs.append((5000, "zebrawordalone"))
    docs.append((5001, prose(rnd, 40) + " zebrawordalone " + prose(rnd, 40)))
    edited = items[3][1].split()
    edited[3] = "changed"
    docs.append((5002, prose(rnd, 90) + "\n" + " ".join(edited) + "\n" + prose(rnd, 90)))
    for shard in (10**9, 150):
        got = {(r.doc_id, r.item_id) for r in decontamination.find(make_docs(docs), frame, shard_chars=shard).collect()}
        want = {(3000 + n, i) for n, (i, t) in enumerate(items) if t and i != 53} | {(5000, 53), (5001, 53), (5002, 3)}
        assert got == want


def test_shards_change_no_row_of_the_decontamination(llm, make_docs):
    """Items of very different lengths, two of one item_id, and repeated documents: the
    rows and all their figures are those of one shard, and those of a plain search."""
    rnd = random.Random(12)
    items = [(i, prose(rnd, n) + ". " + prose(rnd, 6)) for i, n in enumerate([12, 20, 30, 45, 200])]
    shared = prose(rnd, 30)
    items += [(70, shared + ". " + prose(rnd, 6)), (70, shared + ". " + prose(rnd, 7)), (71, shared + ". " + prose(rnd, 6))]
    docs = [(i, prose(rnd, 70) + " " + items[i][1] + " " + prose(rnd, 120)) for i in range(len(items))]
    docs += [docs[5], docs[5], (90, items[5][1] + " " + prose(rnd, 20) + " " + items[6][1]), (91, prose(rnd, 400))]
    frame = llm.createDataFrame(items, "item_id long, text string")
    every = [
        sorted(tuple(r) for r in decontamination.find(make_docs(docs), frame, shard_chars=n).collect())
        for n in (10**9, 1200, 500)
    ]
    assert every[0] == every[1] == every[2]
    df = Counter(t for _, text in items for t in set(decontamination.terms_of(words_of(text))))
    lengths = [len(words_of(t)) for _, t in items]
    index = decontamination.Index(items, df, len(items), sum(lengths) / len(items))
    want = []
    for doc, text in docs:
        best = {}
        for number, found in index.verified(words_of(text)).items():
            best.setdefault(items[number][0], []).append(found)
        want += [(doc, item, *max(f, key=lambda f: (min(f[1:]), *f))) for item, f in best.items()]
    assert sorted((r[0], *r[2:]) for r in every[0]) == sorted(want)
    pairs = Counter((r[0], r[2]) for r in every[0])
    assert pairs[5, 70] == 3 and pairs[90, 70] == 1 and not any(d == 91 for d, _ in pairs)


def test_block_max_wand_finds_what_a_full_scan_finds():
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 12)))) for i in range(120)]
    df = Counter(t for _, text in items for t in set(decontamination.terms_of(words_of(text))))
    index = decontamination.Index(items, df, len(items), 7.0, threshold=0.5)
    for _ in range(200):
        terms = set(decontamination.terms_of([rnd.choice("abcdefgh").encode() for _ in range(12)]))
        score = defaultdict(float)
        for t in terms:
            for number, impact in index.postings.get(t, []):
                score[number] += impact
        want = {n for n, s in score.items() if s >= 0.5 - 1e-9}
        assert {n for n, _ in index.search(terms)} == want


def test_decontamination_of_nothing(llm, make_docs):
    none = llm.createDataFrame([], "item_id long, text string")
    assert decontamination.find(make_docs([(1, "a b c d e f")]), none).count() == 0
    one = llm.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find(make_docs([]), one).count() == 0


def brute_base(rows):
    tokens = [words_of(t or "") + [b""] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not fold(i, 7, 2) for w in ws)
    n, v = sum(count.values()), len(count)
    return Counter(
        (i, fold(i, 7, 2), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6))
        for (i, _), ws in zip(rows, tokens, strict=True))


def test_lm(make_docs, corpus):
    rnd = random.Random(6)
    rows = corpus + [(7000 + i, " ".join(rnd.choice(["a b c d", "e f g h"]) for _ in range(50))) for i in range(40)]
    results = []
    for shard, keys, chars in ((64 << 20, 1 << 19, 4_000_000), (600, 256, 5_000)):
        got = lm.score(make_docs(rows), shard_bytes=shard, segment_keys=keys, chunk_chars=chars).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
        results.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in got))
        repeated = [r for r in got if r.held_out and (r.doc_id or 0) >= 7000]
        assert repeated and all(r.score > 0.7 * r.base_score for r in repeated)
        assert all(r.score <= 0 for r in got)
    # shards and segments change false positives only
    assert all(math.isclose(a[2], b[2], rel_tol=0.05, abs_tol=0.5) for a, b in zip(*results, strict=True))


def test_lm_counts_come_back_quantised():
    keys = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = (np.arange(len(keys)) % 70) + 1
    level = np.where(counts >= 2, lm._levels(np.maximum(counts, 2), 2, 2.0), 0)
    size = int(level.sum()) * lm.BITS_PER_ENTRY
    bits = np.zeros(size, dtype=bool)
    short = keys >> np.uint64(32)
    for j in range(1, int(level.max()) + 1):
        for at in lm._positions(short[level >= j], j, np.uint64(size)):
            bits[at] = True
    shard = lm.Shard(0, 0, np.array([0]), np.array([size]), np.packbits(bits))
    found = shard.level(keys)
    assert (found >= level).all() and (found != level).mean() < 0.02


def test_lm_scores_against_exact_bigram_counts(make_docs):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]  # most bigrams are seen once
    rows = [(i, " ".join(rnd.choice(words) for _ in range(25))) for i in range(50)]
    tokens = {i: words_of(t) + [b""] for i, t in rows}
    learnt = [ws for i, ws in tokens.items() if not fold(i, 7, 2)]
    count, pair = Counter(w for ws in learnt for w in ws), Counter(p for ws in learnt for p in zip([b" ", *ws], ws))
    assert sum(c == 1 for c in pair.values()) > 0.6 * len(pair)
    n, v = sum(count.values()), len(count)
    context = count | {b" ": len(learnt)}
    bucket = lambda before: int(math.log2(context.get(before, 0) + 1))
    gains = {}
    for ws in learnt:
        for before, w in zip([b" ", *ws], ws):
            own = min(1.0, (pair[before, w] - 1) / max(1.0, context[before] - 1))
            for a in lm.WEIGHTS:
                key = bucket(before), a
                gains[key] = gains.get(key, 0.0) + math.log10((1 - a) + a * own / (count[w] / (n + v)))
    best = {b: max(lm.WEIGHTS, key=lambda a, b=b: gains[b, a]) for b, _ in gains}
    assert any(best.values())
    # levels as narrow as whole numbers, so that only false positives differ
    got = {r.doc_id: r.score for r in lm.score(make_docs(rows), base=1.09).collect()}
    for i, ws in tokens.items():
        want = 0.0
        for before, w in zip([b" ", *ws], ws):
            a = best.get(bucket(before), 0.0)
            own = min(1.0, pair[before, w] / max(1, context.get(before, 0)))
            want += math.log10(a * own + (1 - a) * (count[w] + 1) / (n + v + 1))
        assert math.isclose(got[i], want, rel_tol=0.02), (i, got[i], want)


def test_lm_level_means():
    level = lm._levels(np.arange(1, 9), 1, 2.0)
    assert level.tolist() == [1, 2, 2, 3, 3, 3, 3, 4]
    assert np.allclose(lm._estimate(np.array([0, 1, 2]), 1, 2.0), [0, 1, 2.4])


def test_lm_of_nothing(make_docs):
    assert lm.score(make_docs([])).count() == 0
