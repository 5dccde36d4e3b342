"""Account behaviour as of a day.

``daily_profile`` turns the transactions into one row per account and active
day. Distinct counts become additive by counting each partner, format and
currency on the first day the account met it, so every as-of question after
that is a plain or running sum over at most one row per day. The transactions
are read once for both snapshots and all alerts. Their legs move once, to their
accounts; all else happens there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import TriageConfig
from tidewatch.functions.columns import ExactSum, exact_amount

FEATURES = [
    "tx_in_count",
    "tx_out_count",
    "amount_in_total",
    "amount_out_total",
    "counterparty_in_count",
    "counterparty_out_count",
    "payment_format_count",
    "currency_count",
    "max_amount_out",
    "active_day_count",
    "usd_subthreshold_share",
]

_ADDITIVE = [
    "tx_in", "tx_out", "amount_in", "amount_out", "usd_out", "usd_small",
    "partners_in", "partners_out", "formats", "currencies", "days",
]


def account_legs(tx: DataFrame) -> DataFrame:
    """Two legs per payment from one scan: the receiver's and the sender's."""
    received, paid = exact_amount(tx, "amount_received"), exact_amount(tx, "amount_paid")
    zero_in = F.lit(0).cast(tx.select(received.alias("x")).schema["x"].dataType)
    zero_out = F.lit(0).cast(tx.select(paid.alias("x")).schema["x"].dataType)
    legs = F.array(
        F.struct(
            F.col("to_account").alias("acct"), F.col("from_account").alias("cpty"),
            received.alias("amt_in"), zero_out.alias("amt_out"),
        ),
        F.struct(
            F.col("from_account").alias("acct"), F.col("to_account").alias("cpty"),
            zero_in.alias("amt_in"), paid.alias("amt_out"),
        ),
    )
    return tx.select("tx_time", "payment_currency", "payment_format", F.inline(legs))


def daily_profile(tx: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Additive behaviour per (acct, day). Hardly any two legs fall together before they
    meet at their account, so they move as they are, in one narrow exchange."""
    got, gave = F.col("amt_in") > 0, F.col("amt_out") > 0
    usd_out = (F.col("payment_currency") == cfg.currency) & gave
    moved = account_legs(tx).withColumn("day", F.to_date("tx_time")).drop("tx_time").repartition("acct")
    sums = {name: ExactSum(moved.schema[amount].dataType) for name, amount in (("amount_in", "amt_in"), ("amount_out", "amt_out"))}
    legs = moved.select(
        "acct", "cpty", "amt_out", "payment_currency", "payment_format",
        "day",
        sums["amount_in"].units(F.col("amt_in")).alias("amount_in"),
        sums["amount_out"].units(F.col("amt_out")).alias("amount_out"),
        got.cast("int").alias("tx_in"),
        gave.cast("int").alias("tx_out"),
        usd_out.cast("int").alias("usd_out"),
        (usd_out & (F.col("amt_out") < F.lit(cfg.reporting_threshold))).cast("int").alias("usd_small"),
    )

    # One row per thing the leg contributes to. The measures ride on the "day"
    # row only; map-side aggregation folds the others to one row per value.
    def item(kind: str, value: Column, carries: bool) -> Column:
        def measure(name: str) -> Column:
            kept = F.col(name)
            return (kept if carries else F.lit(None).cast(legs.schema[name].dataType)).alias(name)

        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"),
            *[measure(n) for n in ("tx_in", "tx_out", "usd_out", "usd_small", "amount_in", "amount_out", "amt_out")],
        )

    direction = F.when(F.col("tx_in") == 1, F.concat(F.lit("<"), "cpty")).when(
        F.col("tx_out") == 1, F.concat(F.lit(">"), "cpty")
    )
    items = F.array(
        item("day", F.col("day").cast("string"), True),
        item("partner", direction, False),
        item("format", F.col("payment_format"), False),
        item("currency", F.col("payment_currency"), False),
    )
    seen = (
        legs.select("acct", "day", F.inline(items))
        .filter("value IS NOT NULL")
        .groupBy("acct", "kind", "value")
        .agg(
            F.min("day").alias("day"),
            F.sum("tx_in").alias("tx_in"),
            F.sum("tx_out").alias("tx_out"),
            *[part for name in sums for part in sums[name].parts(name, F.col(name))],
            F.sum("usd_out").alias("usd_out"),
            F.sum("usd_small").alias("usd_small"),
            F.max("amt_out").alias("max_out"),
        )
    )
    kind, value = F.col("kind"), F.col("value")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    halves = [half for name in sums for half in sums[name].names(name)]
    summed = seen.groupBy("acct", "day").agg(
        *[total(n) for n in ("tx_in", "tx_out", *halves, "usd_out", "usd_small")],
        F.max("max_out").alias("max_out"),
        F.count_if((kind == "partner") & value.startswith("<")).alias("partners_in"),
        F.count_if((kind == "partner") & value.startswith(">")).alias("partners_out"),
        F.count_if(kind == "format").alias("formats"),
        F.count_if(kind == "currency").alias("currencies"),
        F.count_if(kind == "day").alias("days"),
    )
    return summed.select(
        "acct", "day", "tx_in", "tx_out", *[sums[name].total(name).alias(name) for name in sums],
        *[c for c in summed.columns if c not in ("acct", "day", "tx_in", "tx_out", *halves)],
    )


def _features(add: dict[str, Column], max_out: Column) -> list[Column]:
    """The 11 model inputs from accumulated daily values."""
    return [
        add["tx_in"].alias("tx_in_count"),
        add["tx_out"].alias("tx_out_count"),
        add["amount_in"].cast("double").alias("amount_in_total"),
        add["amount_out"].cast("double").alias("amount_out_total"),
        add["partners_in"].alias("counterparty_in_count"),
        add["partners_out"].alias("counterparty_out_count"),
        add["formats"].alias("payment_format_count"),
        add["currencies"].alias("currency_count"),
        max_out.cast("double").alias("max_amount_out"),
        add["days"].alias("active_day_count"),
        F.try_divide(add["usd_small"].cast("double"), add["usd_out"].cast("double")).alias(
            "usd_subthreshold_share"
        ),
    ]


def snapshot(profile: DataFrame, as_of: Column) -> DataFrame:
    """Features per account from everything strictly before ``as_of``."""
    summed = (
        profile.filter(F.col("day") < as_of)
        .groupBy("acct")
        .agg(
            *[F.sum(name).alias(name) for name in _ADDITIVE],
            F.max("max_out").alias("max_out"),
        )
    )
    add = {name: F.col(name) for name in _ADDITIVE}
    return summed.select("acct", *_features(add, F.col("max_out")))


def history_features(profile: DataFrame, asks: DataFrame) -> DataFrame:
    """Features per asked (acct, day) from everything strictly before that day;
    an account without earlier activity gets no row.

    The asked days join the profile as empty rows, so one running sum per
    account answers all of them: no range join, and one exchange. A profile that is just
    being made lies with its accounts already, and only the asked days move. Days are compared
    by number, so an asked day sees nothing of itself whichever row comes first. A window
    holds at most two rows per calendar day, however many payments the account made.
    """
    marks = asks.select("acct", "day").repartition("acct").distinct().withColumn("asked", F.lit(1))
    merged = profile.unionByName(marks, allowMissingColumns=True).withColumn("_at", F.unix_date("day"))
    before = (
        Window.partitionBy("acct").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    )
    running = merged.select(
        "acct", "day", "asked",
        *[F.sum(name).over(before).alias(name) for name in _ADDITIVE],
        F.max("max_out").over(before).alias("max_out"),
    )
    add = {name: F.col(name) for name in _ADDITIVE}
    return running.filter("asked = 1 AND days > 0").select(
        "acct", "day", *_features(add, F.col("max_out"))
    )
