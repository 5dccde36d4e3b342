"""Secrets in texts: three fixed patterns, and a battery of randomness tests.

Tokens of at least ``MIN_LENGTH`` characters that mix letters and digits and lie
outside the fixed matches are candidates. From its characters a token's encoding is
inferred (hex, base32, alphanumeric in one case, base62, base64), and three tests ask
whether it could be a random string of that encoding: chi-squared uniformity over the
alphabet, the runs test around the alphabet's middle, and lag-1 serial correlation.
The smallest of the three p-values, times three, is the token's p-value.

A false-discovery step over all candidates of all documents (Benjamini-Hochberg) says
which are not random, at level ``LEVEL``. It knows lengths: a token's p-value is
divided by its length over the mean length, as a long string has much more power
against randomness than a short one. What stands is reported as kind ``random``.
P-values are kept as whole steps of 1/64 of a power of e, rounded towards random, so
the step needs counts per step only, which Spark sums; no token leaves its document.

Defined cases: a null text is empty; documents are kept row by row, whatever their
doc_id; an empty table gives no rows; without candidates nothing is added; texts of
any length are read whole. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import column, map_batches, text_list, texts_of
from tidewatch.session import materialize

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 20
LEVEL = 0.05
STEPS = 64
LOWEST = -STEPS * 700

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}=*")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SHAPES = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", re.compile(r"[a-z0-9]+"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", re.compile(r"[A-Z0-9]+"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    spans: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(values: list[int], size: int) -> float:
    """Upper tail by the Wilson-Hilferty approximation."""
    n = len(values)
    counts = [0] * size
    for v in values:
        counts[v] += 1
    stat = sum(c * c for c in counts) * size / n - n
    free = size - 1
    z = ((stat / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: list[int], size: int) -> float:
    high = [2 * v >= size for v in values]
    a = sum(high)
    b = len(high) - a
    if a == 0 or b == 0:
        return 2.0 ** (1 - len(high))
    n = a + b
    seen = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return _normal_tail((seen - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(values: list[int]) -> float:
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread == 0:
        return 2.0 ** (1 - n)
    r = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:], strict=False)) / spread
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def encoding(token: str) -> tuple[str, str]:
    for name, shape, alphabet in _SHAPES:
        if shape.fullmatch(token):
            return name, alphabet
    return "", ""


def randomness(token: str) -> float | None:
    """p-value of 'a random string of its encoding'; None if it is no candidate."""
    token = token.rstrip("=")
    if len(token) < MIN_LENGTH or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None
    name, alphabet = encoding(token)
    if not name:
        return None
    place = {c: i for i, c in enumerate(alphabet)}
    if name == "hex":
        token = token.lower()
    values = [place[{"-": "+", "_": "/"}.get(c, c)] for c in token]
    size = len(alphabet)
    return min(1.0, 3 * min(chi_squared(values, size), runs(values, size), serial(values)))


def _step(p: float) -> int:
    return max(LOWEST, math.ceil(STEPS * math.log(p))) if p > 0 else LOWEST


def _candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    found = []
    for m in _LONG.finditer(text):
        if any(s < m.end() and m.start() < e for s, e, _ in base):
            continue
        p = randomness(m[0])
        if p is not None:
            found.append((m.start(), m.end(), _step(p)))
    return found


_FOUND = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>, "
    "starts array<int>, ends array<int>, steps array<int>"
)


def scan(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in (
                "n_assign", "n_access", "n_hex", "base_sha256", "base", "starts", "ends", "steps")}
            for text in text_list(batch):
                base = base_spans(text)
                more = _candidates(text, base)
                listed = [f"{k}:{s}:{e}" for s, e, k in base]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                out["base_sha256"].append(hashlib.sha256(",".join(listed).encode()).hexdigest())
                out["base"].append(listed)
                for i, name in enumerate(("starts", "ends", "steps")):
                    out[name].append([c[i] for c in more])
            return out | {"doc_id": column(batch, "doc_id")}

        return step

    return map_batches(texts_of(docs), _FOUND, make)


def cutoff(counts: list[tuple[int, int, int]], level: float = LEVEL) -> float:
    """Weighted Benjamini-Hochberg over (step, length, how many): the largest log of a
    weighted p-value that is still rejected as not random, or minus infinity."""
    total = sum(n for _, _, n in counts)
    if not total:
        return -math.inf
    mean = sum(length * n for _, length, n in counts) / total
    weighted = sorted((step / STEPS - math.log(length / mean), n) for step, length, n in counts)
    seen, best = 0, -math.inf
    for value, n in weighted:
        seen += n
        if value <= math.log(level * seen / total):
            best = value
    return best


def mean_length(counts: list[tuple[int, int, int]]) -> float:
    total = sum(n for _, _, n in counts)
    return sum(length * n for _, length, n in counts) / total if total else 1.0


# Lengths beyond this count as this: the weight is bounded, and so are the counts.
LONGEST = 256


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all kinds)."""
    found = materialize(scan(docs), "secret-scan")
    length = F.least(F.col("c.ends") - F.col("c.starts"), F.lit(LONGEST))
    counts = [
        (r["steps"], r["length"], r["n"])
        for r in found.select(F.explode(F.arrays_zip("starts", "ends", "steps")).alias("c"))
        .groupBy(F.col("c.steps").alias("steps"), length.alias("length"))
        .agg(F.count("*").alias("n")).collect()
    ]
    edge, mean = cutoff(counts, level), mean_length(counts)

    def stands(c):
        wide = F.least(c["ends"] - c["starts"], F.lit(LONGEST))
        return c["steps"] / STEPS - F.log(wide / F.lit(mean)) > F.lit(edge)

    random = F.transform(
        F.filter(F.arrays_zip("starts", "ends", "steps"), stands),
        lambda c: F.concat_ws(":", F.lit(KINDS[3]), c["starts"], c["ends"]),
    )
    start = lambda s: F.split(s, ":")[1].cast("int")
    keyed = F.transform(F.concat("base", random), lambda s, i: F.struct(start(s).alias("s"), i.alias("i"), s.alias("t")))
    spans = F.array_join(F.transform(F.sort_array(keyed), lambda x: x["t"]), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))
