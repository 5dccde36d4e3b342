"""Two- and three-leg money cycles.

Transfers are folded into one row per period and unordered account pair, with
the amount of each direction beside each other. A two-cycle is then a row with
both directions: no join. Triangles are searched from their lowest-degree
account only, so a hub is never the middle of a wedge: an account pairs at most
sqrt(2 * pairs) neighbours whatever its own degree, and nothing is left out. Degrees
up to ``LIGHT_DEGREE`` count as equal, so only those above it are joined to the pairs;
an account of such a degree pairs that many neighbours at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.columns import ExactSum
from tidewatch.session import materialize
from tidewatch.sources.files import union_all

LIGHT_DEGREE = 64


def transfer_pairs(legs: DataFrame) -> DataFrame:
    """(period, u, v, forward, backward): amounts u->v and v->u with u <= v.
    ``legs`` has period, both account keys and ``amt``. For a transfer to
    oneself (u = v) both columns hold the amount."""
    sender = F.struct(F.col("from_account").alias("account"), F.col("from_bank").alias("bank"))
    receiver = F.struct(F.col("to_account").alias("account"), F.col("to_bank").alias("bank"))
    sums = ExactSum(legs.schema["amt"].dataType)
    keyed = legs.select("period", sender.alias("a"), receiver.alias("b"), sums.units(F.col("amt")).alias("amt"))
    summed = (
        keyed.select(
            "period",
            F.least("a", "b").alias("u"),
            F.greatest("a", "b").alias("v"),
            F.when(F.col("a") <= F.col("b"), F.col("amt")).alias("up"),
            F.when(F.col("a") >= F.col("b"), F.col("amt")).alias("down"),
        )
        # transfers of a pair hardly ever lie together, so they meet in the exchange
        .repartition("period", "u", "v")
        .groupBy("period", "u", "v")
        .agg(*sums.parts("forward", F.col("up")), *sums.parts("backward", F.col("down")))
    )
    return summed.select("period", "u", "v", *[sums.total(c).alias(c) for c in ("forward", "backward")])


def _close_to(last: Column, first: Column, cfg: RuleConfig) -> Column:
    tolerance = cfg.cycle_tolerance
    return last.between(first * F.lit(1 - tolerance), first * F.lit(1 + tolerance))


def _text(*accounts: Column) -> Column:
    return F.concat_ws("->", *accounts)


def _two_legs(pairs: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Both directions present. Started from either end, the way back must be
    within tolerance of the way out; the path is told from the smaller account."""
    mutual = pairs.filter("forward IS NOT NULL AND backward IS NOT NULL")
    u, v = F.col("u.account"), F.col("v.account")

    def told(out: str, back: str, counts: Column) -> Column:
        row = F.struct(F.col(out).alias("amt_out"), F.col(back).alias("amt_back"))
        return F.when(counts, F.array(row)).otherwise(F.slice(F.array(row), 1, 0))

    from_u = _close_to(F.col("backward"), F.col("forward"), cfg)
    from_v = _close_to(F.col("forward"), F.col("backward"), cfg)
    # u <= v, so the path starts at u. Equal account names at two banks leave
    # the start open: then each end tells its own amounts.
    same_name = (u == v) & (F.col("u.bank") != F.col("v.bank"))
    rows = F.concat(
        told("forward", "backward", from_u | (from_v & ~same_name)),
        told("backward", "forward", from_v & same_name),
    )
    return mutual.select("period", "u", "v", F.inline(rows)).select(
        "period",
        u.alias("entity"),
        _text(u, v, u).alias("path"),
        "amt_out",
        "amt_back",
        F.lit(2).alias("cycle_len"),
    )


def _triangles(pairs: DataFrame) -> DataFrame:
    """Directed three-cycles over distinct accounts, each found exactly once:
    (period, a, b, c, ab, bc, ca)."""
    ends = pairs.select("period", F.explode(F.array("u", "v")).alias("node"))
    degree = ends.groupBy("period", "node").agg(F.count(F.lit(1)).alias("degree"))
    # written down, so that a short table is known to be short before the joins are planned
    heavy = materialize(degree.filter(F.col("degree") > LIGHT_DEGREE), "heavy-accounts")

    def of(end: str) -> DataFrame:
        return heavy.select("period", F.col("node").alias(end), F.col("degree").alias(f"{end}_degree"))

    ranked = (
        pairs.join(of("u"), ["period", "u"], "left")
        .join(of("v"), ["period", "v"], "left")
        .fillna(0, ["u_degree", "v_degree"])
    )
    # point every pair from the lower to the higher (degree, account) end
    u_first = F.struct("u_degree", "u") < F.struct("v_degree", "v")
    pointed = materialize(
        ranked.select(
            "period",
            F.when(u_first, F.col("u")).otherwise(F.col("v")).alias("low"),
            F.when(u_first, F.col("v")).otherwise(F.col("u")).alias("high"),
            F.when(u_first, F.col("v_degree")).otherwise(F.col("u_degree")).alias("degree"),
            F.when(u_first, F.col("forward")).otherwise(F.col("backward")).alias("rise"),
            F.when(u_first, F.col("backward")).otherwise(F.col("forward")).alias("fall"),
        ),
        "pointed-pairs",
    )
    left = pointed.select(
        "period", "low", F.col("high").alias("q"), F.col("degree").alias("q_degree"),
        F.col("rise").alias("pq"), F.col("fall").alias("qp"),
    )
    right = pointed.select(
        "period", "low", F.col("high").alias("r"), F.col("degree").alias("r_degree"),
        F.col("rise").alias("pr"), F.col("fall").alias("rp"),
    )
    clockwise = F.col("pq").isNotNull() & F.col("rp").isNotNull()
    counter = F.col("pr").isNotNull() & F.col("qp").isNotNull()
    wedges = left.join(right, ["period", "low"]).filter(
        (F.struct("q_degree", "q") < F.struct("r_degree", "r")) & (clockwise | counter)
    )
    closing = pointed.select(
        "period", F.col("low").alias("q"), F.col("high").alias("r"),
        F.col("rise").alias("qr"), F.col("fall").alias("rq"),
    )

    def around(b: str, c: str, ab: str, bc: str, ca: str) -> Column:
        return F.struct(
            F.col("low").alias("a"), F.col(b).alias("b"), F.col(c).alias("c"),
            F.col(ab).alias("ab"), F.col(bc).alias("bc"), F.col(ca).alias("ca"),
        )

    ways = F.array(around("q", "r", "pq", "qr", "rp"), around("r", "q", "pr", "rq", "qp"))
    return (
        wedges.join(closing, ["period", "q", "r"])
        .select("period", F.inline(ways))
        .filter("ab IS NOT NULL AND bc IS NOT NULL AND ca IS NOT NULL")
    )


def _with_loops(pairs: DataFrame, loops: DataFrame) -> DataFrame:
    """Three-cycles that use a transfer to oneself: the loop three times, or a
    loop on either end of a two-way pair."""
    alone = loops.select(
        "period",
        F.col("u").alias("a"), F.col("u").alias("b"), F.col("u").alias("c"),
        F.col("forward").alias("ab"), F.col("forward").alias("bc"), F.col("forward").alias("ca"),
    )
    mutual = pairs.filter("forward IS NOT NULL AND backward IS NOT NULL")
    loop = loops.select("period", F.col("u").alias("node"), F.col("forward").alias("own"))
    ends = mutual.select(
        "period",
        F.inline(
            F.array(
                F.struct(
                    F.col("u").alias("node"), F.col("v").alias("other"),
                    F.col("forward").alias("out"), F.col("backward").alias("back"),
                ),
                F.struct(
                    F.col("v").alias("node"), F.col("u").alias("other"),
                    F.col("backward").alias("out"), F.col("forward").alias("back"),
                ),
            )
        ),
    )
    hooked = ends.join(loop, ["period", "node"]).select(
        "period",
        F.col("node").alias("a"), F.col("node").alias("b"), F.col("other").alias("c"),
        F.col("own").alias("ab"), F.col("out").alias("bc"), F.col("back").alias("ca"),
    )
    return alone.unionByName(hooked)


def _three_legs(cycles: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Each cycle may start at any of its accounts; a start counts when the last
    leg is within tolerance of the first. The path is told from the smallest
    account name, which for equal names depends on the start."""

    def start(x: str, y: str, z: str, first: str, second: str, last: str) -> Column:
        return F.struct(
            F.col(f"{x}.account").alias("x"), F.col(f"{y}.account").alias("y"),
            F.col(f"{z}.account").alias("z"), F.col(first).alias("first"),
            F.col(second).alias("second"), F.col(last).alias("last"),
        )

    starts = F.array(
        start("a", "b", "c", "ab", "bc", "ca"),
        start("b", "c", "a", "bc", "ca", "ab"),
        start("c", "a", "b", "ca", "ab", "bc"),
    )
    told = (
        cycles.select("period", F.inline(starts))
        .filter(_close_to(F.col("last"), F.col("first"), cfg))
        .withColumn("entity", F.least("x", "y", "z"))
    )
    x, y, z, smallest = F.col("x"), F.col("y"), F.col("z"), F.col("entity")
    at_x, at_y = x == smallest, y == smallest
    return told.select(
        "period",
        "entity",
        F.when(at_x, _text(x, y, z, x)).when(at_y, _text(y, z, x, y))
        .otherwise(_text(z, x, y, z)).alias("path"),
        F.when(at_x, F.col("first")).when(at_y, F.col("second"))
        .otherwise(F.col("last")).alias("amt_out"),
        F.when(at_x, F.col("last")).when(at_y, F.col("first"))
        .otherwise(F.col("second")).alias("amt_back"),
        F.lit(3).alias("cycle_len"),
    )


def find_cycles(pairs: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Distinct (period, entity, path, amt_out, amt_back, cycle_len)."""
    if not cfg.cycle_lengths or not set(cfg.cycle_lengths) <= {2, 3}:
        raise ValueError("cycle lengths are limited to 2 and 3")
    pairs = materialize(pairs, "transfer-pairs")
    loops = pairs.filter(F.col("u") == F.col("v"))
    proper = pairs.filter(F.col("u") != F.col("v"))
    found = []
    if 2 in cfg.cycle_lengths:
        found.append(_two_legs(proper if cfg.exclude_self_loops else pairs, cfg))
    if 3 in cfg.cycle_lengths:
        rings = _triangles(proper)
        if not cfg.exclude_self_loops:
            rings = rings.unionByName(_with_loops(proper, loops))
        found.append(_three_legs(rings, cfg))
    return union_all(found).distinct()
