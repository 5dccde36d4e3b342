"""Exact Jaccard self-join on word shingles with signature trees, and its components.

Links are exact: two documents link when 100 * |A and B| >= 75 * |A or B| over their
sets of distinct 5-word shingles (64-bit hashes of them). The way there:

1. Documents are read once, in chunks. Each chunk sends its shingles to segments of
   the hash range, which answer in how many documents each occurs (``marks``). A linked
   document shares at least 75 % of its shingles with some other one; all others
   are finished here.
2. Documents with equal sets are one class; classes are represented by one document.
3. Two linked classes share one of the rarest 25 % of their shingles (prefix filter, in
   the order of step 1's counts). Classes that meet so form clusters.
4. A cluster is cut into blocks of one size band and at most some hundred classes.
   Per block a signature tree is built: leaves hold a few sets, every node the
   OR-combined token bitmap, the size range and the number of shingles its members
   lose to bit collisions at most. Two trees are walked together; a pair of nodes is
   left out if the largest overlap it could hold falls short. Pairs of sets that
   survive are compared exactly, unless they are connected already.
5. Every block meets its cluster's first block; then the blocks themselves are the
   nodes: pairs of them that could still hold a new link are walked in a second round.

Nothing is capped: a cluster of any size is finished in blocks, groups of near copies
connect in the first round and need no second one.

Defined cases: a null or blank text has no shingles and is its own component; with
fewer than five words the sequence of words is the one shingle; rows may repeat and
doc_ids too, rows of one doc_id are told apart by their text; a null doc_id is
the largest; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column, mix64, text_list, texts_of, words_of
from tidewatch.llm.components import components
from tidewatch.session import materialize

WIDTH = 5
SHARE = 75  # of 100
CHUNK_CHARS = 4_000_000
SEGMENT_KEYS = 1 << 20
BLOCK = 256
LEAF = 8
FAN = 4
BITS = 4096
NO_ID = (1 << 63) - 1
DF_LIMIT = 65535


def _word_hashes(words: list[bytes]) -> np.ndarray:
    codes: dict[bytes, int] = {}
    index = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    values = np.empty(len(codes), dtype=object)
    values[:] = list(codes)
    return pd.util.hash_array(values, categorize=False)[index] if words else np.zeros(0, dtype=np.uint64)


def _shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of the whole if there are fewer."""
    with np.errstate(over="ignore"):
        width = min(width, len(hashes))
        total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for i in range(width):
            total = (total + hashes[i : len(hashes) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(total + np.uint64(width))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = words_of(text)
    return np.unique(_shingle_hashes(_word_hashes(words), width)) if words else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """``shingle_set`` of many texts, hashing each distinct word once."""
    words = [words_of(t) for t in texts]
    hashes = _word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        mine = hashes[at : at + len(ws)]
        at += len(ws)
        out.append(np.unique(_shingle_hashes(mine, width)) if ws else np.zeros(0, dtype=np.uint64))
    return out


def _digest(keys: np.ndarray) -> int:
    """64-bit digest of a set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(np.sum(mix64(keys + np.uint64(len(keys))), dtype=np.uint64).astype(np.int64)) if len(keys) else 0


def _needed(n: int) -> int:
    """Least overlap of a set of n with any linked one."""
    return -(-SHARE * n // 100)


_SENT = pa.schema([
    ("segment", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())),
])
_SENT_SCHEMA = (
    "segment long, chunk long, keys binary, lengths binary, doc_ids array<long>, text_keys array<long>, "
    "classes array<long>, sizes array<long>"
)


def _send_shingles(bits: int, width: int, chunk_chars: int):
    shift = np.uint64(32 - bits) if bits < 32 else np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        sets: list[np.ndarray] = []
        ids: list[int | None] = []
        texts: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            chunk = (part << 32) + number
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            segment = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            order = np.argsort(segment, kind="stable")
            keys, owner, segment = keys[order], owner[order], segment[order]
            at = np.searchsorted(segment, np.arange((1 << bits) + 1))
            out: dict[str, list] = {f.name: [] for f in _SENT}
            for s in range(1 << bits):
                a, b = int(at[s]), int(at[s + 1])
                if b > a:
                    out["segment"].append(s)
                    out["keys"].append((keys[a:b] >> shift).astype(np.uint32).tobytes())
                    out["lengths"].append(np.bincount(owner[a:b], minlength=len(sets)).astype(np.uint32).tobytes())
                    for name in ("doc_ids", "text_keys", "classes", "sizes"):
                        out[name].append(None)
            # the chunk's own row: a group by itself
            out["segment"].append(-1 - chunk)
            out["keys"].append(None)
            out["lengths"].append(None)
            out["doc_ids"].append(ids)
            out["text_keys"].append(texts)
            out["classes"].append([_digest(s) for s in sets])
            out["sizes"].append([len(s) for s in sets])
            out["chunk"] = [chunk] * len(out["segment"])
            return as_batch(out, _SENT)

        for batch in batches:
            found = text_list(batch)
            sets += shingle_sets(found, width)
            ids += column(batch, "doc_id").to_pylist()
            texts += column(batch, "text_key").to_pylist()
            size += sum(map(len, found))
            if size >= chunk_chars:
                yield close()
                number, sets, ids, texts, size = number + 1, [], [], [], 0
        if ids:
            yield close()

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Per chunk: documents that hold each of its shingles, in the order sent."""
    group = group.select(_SENT.names)
    if group.column("segment")[0].as_py() < 0:
        return group.append_column("counts", pa.nulls(group.num_rows, pa.binary())).drop(["keys"])
    keys = [np.frombuffer(k, dtype=np.uint32) for k in group.column("keys").to_pylist()]
    _, where, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    counts = np.minimum(times, DF_LIMIT).astype(np.uint16)[where]
    ends = np.cumsum([len(k) for k in keys])
    back = [counts[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]
    return group.append_column("counts", pa.array(back, pa.binary())).drop(["keys"])


_MARK_SCHEMA = "doc_id long, text_key long, class long, n long, shared boolean, counts binary"


def _gather(group: pa.Table) -> pa.Table:
    """Documents of one chunk: is enough shared, and if so the counts of its sorted
    shingles (segments are stretches of the hash range, so order is kept)."""
    rows = group.to_pylist()
    own = next(r for r in rows if r["segment"] < 0)
    sizes = np.array(own["sizes"], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()), dtype=np.uint16)
    at = np.cumsum(sizes) - sizes
    for r in sorted((r for r in rows if r["segment"] >= 0), key=lambda r: r["segment"]):
        lengths = np.frombuffer(r["lengths"], dtype=np.uint32).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        flat[np.repeat(at, lengths) + inside] = np.frombuffer(r["counts"], dtype=np.uint16)
        at = at + lengths
    begin = np.cumsum(sizes) - sizes
    total = np.concatenate([[0], np.cumsum(flat >= 2)])
    shared = (total[begin + sizes] - total[begin] >= -(-SHARE * sizes // 100)) & (sizes > 0)
    return pa.table({
        "doc_id": pa.array(own["doc_ids"], pa.int64()), "text_key": pa.array(own["text_keys"], pa.int64()),
        "class": pa.array(own["classes"], pa.int64()), "n": pa.array(sizes, pa.int64()),
        "shared": pa.array(shared),
        "counts": pa.array([flat[b : b + n].tobytes() if s else None for b, n, s in zip(begin, sizes, shared, strict=True)], pa.binary()),
    })


def _bits_for(total: int, per_segment: int) -> int:
    return max(0, math.ceil(math.log2(max(1, total / per_segment))))


def marks(docs: DataFrame, width: int = WIDTH, segment_keys: int = SEGMENT_KEYS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, text_key, class, n, shared, counts: one row per document."""
    rows = texts_of(docs).withColumn("text_key", F.xxhash64("text"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bits = _bits_for(chars // 6, segment_keys)
    sent = rows.mapInArrow(_send_shingles(bits, width, chunk_chars), _SENT_SCHEMA)
    names = "segment long, chunk long, lengths binary, doc_ids array<long>, text_keys array<long>, classes array<long>, sizes array<long>, counts binary"
    answered = sent.groupBy("segment").applyInArrow(_answer, names)
    return materialize(answered.groupBy("chunk").applyInArrow(_gather, _MARK_SCHEMA), "shingle-marks")


_SET_SCHEMA = "class long, n long, keys binary, rare array<long>"


def _sets_of(width: int):
    """Sets of the representatives, with the prefix of each: its rarest shingles that
    occur in another document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("rare", pa.list_(pa.int64()))])
        for batch in batches:
            out: dict[str, list] = {"n": [], "keys": [], "rare": []}
            sets = shingle_sets(text_list(batch), width)
            for keys, raw in zip(sets, column(batch, "counts").to_pylist(), strict=True):
                counts = np.frombuffer(raw, dtype=np.uint16)
                order = np.lexsort((keys, counts))[: len(keys) - _needed(len(keys)) + 1]
                out["n"].append(len(keys))
                out["keys"].append(keys.tobytes())
                out["rare"].append(keys[order][counts[order] >= 2].astype(np.int64))
            yield as_batch(out | {"class": column(batch, "class")}, arrow)

    return run


class Tree:
    """Signature tree over sets; nodes lie in arrays, the leaves' level first."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets], dtype=np.int64)
        # near copies side by side: by smallest hash, then size
        self.order = np.lexsort((size, np.array([s[0] for s in sets], dtype=np.uint64)))
        bits = np.zeros((len(sets), BITS), dtype=bool)
        for row, i in enumerate(self.order):
            bits[row, (sets[i] & np.uint64(BITS - 1)).astype(np.int64)] = True
        size = size[self.order]
        lost = size - bits.sum(axis=1)
        self.children: list[list[int]] = []
        self.rows: list[range | None] = []
        low, high, most, maps = [], [], [], []
        level: list[int] = []
        for a in range(0, len(sets), LEAF):
            b = min(len(sets), a + LEAF)
            level.append(len(low))
            low.append(int(size[a:b].min()))
            high.append(int(size[a:b].max()))
            most.append(int(lost[a:b].max()))
            maps.append(np.packbits(bits[a:b].any(axis=0)))
            self.children.append([])
            self.rows.append(range(a, b))
        while len(level) > 1:
            upper = []
            for a in range(0, len(level), FAN):
                below = level[a : a + FAN]
                upper.append(len(low))
                low.append(min(low[c] for c in below))
                high.append(max(high[c] for c in below))
                most.append(max(most[c] for c in below))
                maps.append(np.bitwise_or.reduce([maps[c] for c in below]))
                self.children.append(below)
                self.rows.append(None)
            level = upper
        self.low, self.high, self.lost, self.maps = low, high, most, maps
        self.root = level[0]


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def could_link(a: Tree, x: int, b: Tree, y: int) -> bool:
    """Can some set below node x of a link with one below node y of b? Common shingles
    share a bit, and a member loses at most ``lost`` of its own to collisions."""
    if 100 * a.high[x] < SHARE * b.low[y] or 100 * b.high[y] < SHARE * a.low[x]:
        return False
    both = int(_ONES[a.maps[x] & b.maps[y]].sum()) + min(a.lost[x], b.lost[y])
    most = min(a.high[x], b.high[y], both)
    # overlap >= SHARE / (100 + SHARE) of both sizes
    return (100 + SHARE) * most >= SHARE * (a.low[x] + b.low[y])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= SHARE * (n - common)


class Groups:
    """Union-find over local numbers; knows how many groups are left."""

    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.parent = [first.setdefault(v, i) for i, v in enumerate(labels)]
        self.left = len(first)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)
        self.left -= 1


def dual_walk(a: Tree, b: Tree, groups: Groups, base_a: int, base_b: int) -> Iterator[tuple[int, int]]:
    """New links between sets of a and b (within a, if it is b), as local numbers."""
    stack = [(a.root, b.root)]
    same = a is b
    while stack and groups.left > 1:
        x, y = stack.pop()
        if not could_link(a, x, b, y):
            continue
        if a.children[x] or b.children[y]:
            if a.children[x] and (not b.children[y] or x >= y):
                below = [(c, y) for c in a.children[x]]
                if same and x == y:
                    kids = a.children[x]
                    below = [(c, d) for i, c in enumerate(kids) for d in kids[i:]]
            else:
                below = [(x, c) for c in b.children[y]]
            stack.extend(below)
            continue
        for i in a.rows[x]:
            for j in b.rows[y]:
                if same and x == y and j <= i:
                    continue
                p, q = base_a + int(a.order[i]), base_b + int(b.order[j])
                if groups.find(p) != groups.find(q) and linked(a.sets[a.order[i]], b.sets[b.order[j]]):
                    groups.join(p, q)
                    yield p, q


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _walk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one pair of blocks follow each other: pair, side, class, group, keys,
    inner (are links within side 1 asked for, too?)."""
    def solve(rows: list[dict]) -> pa.RecordBatch:
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        members = sides[0] + sides[1]
        groups = Groups([r["group"] for r in members])
        trees = [Tree([np.frombuffer(r["keys"], dtype=np.uint64) for r in side]) if side else None for side in sides]
        found: list[tuple[int, int]] = []
        cut = len(sides[0])
        if trees[1] and rows[0]["inner"]:
            found += dual_walk(trees[1], trees[1], groups, cut, cut)
        if trees[0] and trees[1]:
            found += dual_walk(trees[0], trees[1], groups, 0, cut)
        return as_batch({"u": [members[i]["class"] for i, _ in found], "v": [members[j]["class"] for _, j in found]}, _LINKS)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["pair"] != row["pair"]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _walk(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs``: pair, side, block, inner. ``members``: block, class, group, keys."""
    rows = members.join(pairs, "block").select("pair", "side", "class", "group", "keys", "inner")
    dealt = rows.repartition("pair").sortWithinPartitions("pair", "side", "class")
    return materialize(dealt.mapInArrow(_walk_pairs, "u long, v long"), "shingle-links")


def _sides(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, inner) as one row per side; a = b is side 1 alone."""
    named = pairs.withColumn("pair", F.xxhash64("a", "b"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block"))))
    return named.select("pair", "inner", F.explode(sides).alias("s")).select("pair", "s.side", "s.block", "inner")


def _class_links(sets: DataFrame) -> DataFrame:
    """u, v: links between classes, enough of them to connect what is connected."""
    met = sets.select("class", F.explode("rare").alias("token"))
    least = met.groupBy("token").agg(F.min("class").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = met.join(least, "token").where("class <> m").select(F.col("class").alias("u"), F.col("m").alias("v"))
    clusters = components(stars)
    heads = clusters.select(F.col("label").alias("class"), F.col("label").alias("cluster")).distinct()
    placed = heads.unionAll(clusters.select(F.col("vertex").alias("class"), F.col("label").alias("cluster")))
    # linked sets lie in the same or in neighbouring bands
    band = F.floor(F.log("n") / math.log(100 / SHARE)).cast("int")
    kept = materialize(
        sets.select("class", "n", "keys").join(placed, "class").withColumn("band", band), "shingle-clusters")
    counted = kept.groupBy("cluster", "band").agg(F.count("*").alias("k"))
    parts = F.ceil(F.col("k") / BLOCK)
    block = F.xxhash64("cluster", "band", F.pmod(F.xxhash64("class"), parts))
    members = kept.join(counted, ["cluster", "band"]).select(
        "cluster", "band", "class", "n", "keys", block.alias("block"))
    blocks = materialize(
        members.groupBy("block").agg(F.first("cluster").alias("cluster"), F.first("band").alias("band"),
                                     F.min("n").alias("low"), F.max("n").alias("high")), "shingle-blocks")
    # first round: every block with itself and with the first block of its band and of
    # the band below
    first = blocks.groupBy("cluster", "band").agg(F.min("block").alias("head"))
    here = blocks.join(first, ["cluster", "band"]).select(F.col("head").alias("a"), F.col("block").alias("b"), F.lit(True).alias("inner"))
    lower = first.select("cluster", (F.col("band") + 1).alias("band"), "head")
    under = blocks.join(lower, ["cluster", "band"]).select(F.col("head").alias("a"), F.col("block").alias("b"), F.lit(False).alias("inner"))
    own = members.withColumn("group", F.col("class"))
    round_one = _walk(_sides(here.unionAll(under)), own)
    # second round: the other pairs of blocks that are not one group already
    many = blocks.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1").select("cluster")
    left = members.join(many, "cluster", "left_semi")
    joined = components(round_one)
    regrouped = materialize(
        left.join(joined.select(F.col("vertex").alias("class"), "label"), "class", "left")
        .select("cluster", "band", "block", "class", "n", "keys", F.coalesce("label", "class").alias("group")),
        "shingle-regrouped")
    nodes = regrouped.groupBy("block").agg(
        F.first("cluster").alias("cluster"), F.first("band").alias("band"), F.min("n").alias("low"),
        F.max("n").alias("high"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    nodes = nodes.join(first, ["cluster", "band"])
    a = nodes.select([F.col(c).alias(f"a_{c}") if c != "cluster" else F.col(c) for c in nodes.columns])
    b = nodes.select([F.col(c).alias(f"b_{c}") if c != "cluster" else F.col(c) for c in nodes.columns])
    near = (F.col("b_band") - F.col("a_band")).isin(0, 1)
    once = (F.col("a_band") < F.col("b_band")) | (F.col("a_block") < F.col("b_block"))
    done = F.col("a_block") == F.col("a_head")  # the first blocks met all others
    fits = 100 * F.col("a_high") >= SHARE * F.col("b_low")
    one = (F.col("a_g0") == F.col("a_g1")) & (F.col("b_g0") == F.col("b_g1")) & (F.col("a_g0") == F.col("b_g0"))
    pairs = a.join(b, "cluster").where(near & once & ~done & fits & ~one).select(
        F.col("a_block").alias("a"), F.col("b_block").alias("b"), F.lit(False).alias("inner"))
    round_two = _walk(_sides(pairs), regrouped)
    return round_one.unionAll(round_two)


def join(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, label (a number of the component that
    holds also where doc_ids repeat)."""
    found = marks(docs, width)
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    shared = found.where("shared")
    classes = materialize(
        shared.groupBy("class").agg(F.min(F.struct(key.alias("id"), "text_key", "counts")).alias("r"))
        .select("class", "r.id", "r.text_key", "r.counts"), "shingle-classes")
    texts = texts_of(docs).withColumn("text_key", F.xxhash64("text")).withColumn("id", key).select("id", "text_key", "text")
    chosen = texts.join(classes, ["id", "text_key"]).dropDuplicates(["class"]).select("class", "counts", "text")
    sets = materialize(chosen.mapInArrow(_sets_of(width), _SET_SCHEMA), "shingle-sets")
    labels = components(_class_links(sets))
    named = classes.select("class", "id").join(labels.withColumnRenamed("vertex", "class"), "class", "left").select(
        "class", "id", F.coalesce("label", "class").alias("label"))
    named = materialize(named, "shingle-components")
    smallest = named.groupBy("label").agg(F.min("id").alias("component"))
    by_class = named.join(smallest, "label").select("class", "component", "label")
    own = ["doc_id", "text_key", F.col("n").alias("n_shingles")]
    placed = shared.join(by_class, "class").select(*own, "component", "label")
    alone = found.where("not shared").select(*own, key.alias("component"), F.col("class").alias("label"))
    everything = placed.unionAll(alone)
    return everything.select(
        "doc_id", "text_key", "n_shingles", "label",
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))
