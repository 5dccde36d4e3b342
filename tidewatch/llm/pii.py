"""Personal data in texts: four fixed kinds, and identifiers found by their context.

DataFrame functions only. The fixed kinds are regular expressions; a text is split at
the matches, so that the lengths of pieces and matches give each match's place.

Bootstrapped contextual extraction: every match, and every identifier-like token
(``CANDIDATE``) outside the matches, is an instance; the two words before it, with
digits folded, are its lexical pattern. Matches of the fixed kinds are the seeds, the
first known instances. The bipartite graph of distinct patterns and instances is scored
in rounds: a pattern's score is its known instances over all its instances, pulled down
by ``DOUBT`` unknown ones. A pattern of score ``CONFIDENCE`` with ``SUPPORT`` distinct
known instances makes its further instances known, so identifiers found behind one
pattern carry the next one. Known instances only grow in number; the rounds end when none
is added. A known identifier is reported wherever it stands outside a match of a fixed
kind, as kind ``context``.

Defined cases: a null text is empty; rows are handled one by one, whatever their
doc_id; an empty table gives no rows; further columns are ignored; a match with
nothing before it has no pattern and takes no part in the graph. The expressions
neither recurse nor scan a run of characters twice, so a text may be of any length; only
its candidates are compared with its matches one by one. Patterns of more than
``LONG_PATTERN`` characters go by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import texts_of
from tidewatch.session import materialize

# Fixed values, same matches as the contract's patterns: possessive repeats and
# "not inside such a run, or right behind the last match" only spare backtracking.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CONTEXT = "context"
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{4,}+(?!@)(?!\.[A-Za-z0-9])"
)
LAST_WORDS = r"(?<!\S)(?:\S++\s++)?\S++\s*+\z"
LONG_PATTERN = 200
BLOCK = 512  # matches appended to one array before it joins the others
DOUBT = 1.0
SUPPORT = 3
CONFIDENCE = 0.7


def _spans(pairs: str) -> Column:
    """[start, end, match, words before it] of each (piece, match), ends exclusive. An
    append copies an array, so the spans are gathered in blocks."""
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.alias("s"), end.alias("e"), x["m"].alias("m"),
            F.regexp_extract(x["p"], LAST_WORDS, 0).alias("b"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        done = F.aggregate(
            F.slice(pairs, first, BLOCK), F.struct(acc["at"].alias("at"), none.alias("out")), one,
            lambda d: F.struct(d["at"].alias("at"), F.array(d["out"]).alias("out")),
        )
        return F.transform(F.array(done), lambda d: F.struct(
            d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))[0]

    firsts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))).otherwise(
        F.array().cast("array<int>"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string,b:string>>>").alias("out"))
    return F.aggregate(firsts, empty, block, lambda acc: F.flatten(acc["out"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, turned.substr(i, F.lit(1)).cast("int")).otherwise(
            (turned.substr(i, F.lit(1)).cast("int") * 2) % 10 + F.floor(turned.substr(i, F.lit(1)).cast("int") * 2 / 10).cast("int")
        ),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0++", "")
            return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(match, r"\."), small)
    digits = _digits(match)
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15)


def _checker(kind: str):
    return lambda x: _valid(kind, x["m"])


def _cut(df: DataFrame, name: str, pattern: str, needs: Column) -> DataFrame:
    """Adds ``name``: spans of the pattern's matches; texts without ``needs`` have none."""
    none = F.array().cast("array<string>")
    hits = f"{name}_hits"
    df = df.withColumn(hits, F.when(needs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    pieces = F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(none)
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("p"), F.col(hits).alias("m"))
    df = df.withColumn(f"{name}_pairs", pairs)
    return df.withColumn(name, _spans(f"{name}_pairs")).drop(hits, f"{name}_pairs")


def scan(docs: DataFrame, *more: Column, texts: bool = False) -> DataFrame:
    """Per row: doc_id, the valid matches of each kind, and ``others``: candidates
    outside them, all as arrays of (s, e, m, b); with ``texts`` the text; and ``more``."""
    rows = texts_of(docs, *more)
    keep = [c for c in rows.columns if c not in ("doc_id", "text")] + ["text"] * texts
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    needs = {
        "email": F.contains("text", F.lit("@")), "ip": F.col("digit"), "card": F.col("digit"),
        "phone": F.contains("text", F.lit("+")) & F.col("digit"),
    }
    for kind, pattern in KINDS.items():
        rows = _cut(rows, kind, pattern, needs[kind])
        rows = rows.withColumn(kind, F.filter(kind, _checker(kind)))
    rows = _cut(rows, "others", CANDIDATE, F.col("digit"))
    rows = rows.withColumn("all", F.concat(*KINDS))
    rows = rows.withColumn("others", F.filter("others", lambda x: ~F.exists(
        "all", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
    return rows.select("doc_id", *KINDS, "others", *keep)


def _pattern(before: Column) -> Column:
    """The words before a match, lower-cased, digits as 0; null if there are none."""
    words = F.trim(F.regexp_replace(F.lower(before), r"\s++", " "))
    folded = F.regexp_replace(words, "[0-9]", "0")
    return F.nullif(F.when(F.length(folded) > LONG_PATTERN, F.sha2(folded, 256)).otherwise(folded), F.lit(""))


def _occurrences(found: DataFrame) -> DataFrame:
    """row, s, e, pattern (null if nothing is before it), instance, seed."""
    def named(column: str, seed: bool) -> Column:
        return F.transform(column, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), _pattern(x["b"]).alias("pattern"),
            F.lower(x["m"]).alias("instance"), F.lit(seed).alias("seed")))

    listed = F.concat(*(named(k, True) for k in KINDS), named("others", False))
    return found.select("row", F.explode(listed).alias("o")).select("row", "o.*")


def known_instances(seen: DataFrame) -> DataFrame:
    """(instance, seed): the seeds and all that confident patterns add, from occurrences.
    All steps are grouped sums over the distinct (pattern, instance) pairs, combined before
    they are shuffled. A round without a new instance is the last."""
    edges = materialize(seen.where(F.col("pattern").isNotNull()).groupBy("pattern", "instance").agg(
        F.max("seed").alias("seed")), "pii-graph")
    known = materialize(edges.groupBy("instance").agg(F.max("seed").alias("seed")).where("seed"), "pii-known")
    number = known.count()
    while number:
        score = F.count("seed") / (F.count("*") + DOUBT)
        confident = edges.select("pattern", "instance").join(known, "instance", "left").groupBy("pattern").agg(
            score.alias("score"), F.count("seed").alias("support")
        ).where((F.col("score") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        reached = edges.join(confident, "pattern", "left_semi").select("instance", F.lit(False).alias("seed"))
        known = materialize(
            known.unionByName(reached).groupBy("instance").agg(F.max("seed").alias("seed")), "pii-known")
        before, number = number, known.count()
        if number == before:
            break
    return known


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def extract(docs: DataFrame, *more: Column, texts: bool = False) -> DataFrame:
    """row (a number of this run), doc_id, the kinds' spans, ``found`` (the spans of
    kind context, in order), with ``texts`` the text, and ``more``."""
    stored = scan(docs, *more, texts=texts).withColumn("row", F.monotonically_increasing_id())
    stored = materialize(stored, "pii-scan")
    seen = _occurrences(stored)
    known = known_instances(seen)
    more = seen.where(~F.col("seed")).join(known.select("instance"), "instance", "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("s", "e"))).alias("found"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return stored.join(more, "row", "left").withColumn("found", F.coalesce("found", none))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.concat(*(_listed(k) for k in KINDS))
    more = F.transform("found", lambda x: F.concat_ws(":", F.lit(CONTEXT), x["s"], x["e"]))
    return extract(docs).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each (s, e, tag) span replaced by its tag; overlapping ones by the
    first one's."""
    done = F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(
                F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["tag"]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def tagged(kinds: dict[str, str]) -> Column:
    """All spans of an ``extract`` row with the tags to put in their place."""
    def named(column: str, tag: str) -> Column:
        return F.transform(column, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(tag).alias("tag")))

    return F.concat(*(named(column, tag) for column, tag in kinds.items()))
