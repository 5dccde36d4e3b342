"""Column helpers: calendar periods, exact amounts and their text form."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide enough for 10^14 units with six decimals; sums stay exact, so results
# do not depend on how rows are partitioned.
AMOUNT = T.DecimalType(20, 6)

PERIODS = {"day": None, "week": "week", "month": "month"}


def period_start(ts: Column | str, window: str) -> Column:
    """First day of the tumbling calendar period a timestamp falls into."""
    if window not in PERIODS:
        raise ValueError(f"window must be one of {sorted(PERIODS)}, got {window!r}")
    day = F.to_date(ts)
    return day if PERIODS[window] is None else F.trunc(day, PERIODS[window])


def exact_amount(df: DataFrame, name: str) -> Column:
    """Amount column as a decimal: decimals pass through, doubles are cast."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name)
    return F.col(name).cast(AMOUNT)


@dataclass(frozen=True)
class ExactSum:
    """Sums of an exact amount in whole units of its last digit. Sums of decimals are held as
    big numbers and made anew with every row; here the upper and the lower 32 bits of the
    units are summed as longs, which stays exact for two billion rows of any amount. Types
    that do not fit a long keep decimals."""

    amount: T.DecimalType

    @property
    def split(self) -> bool:
        return self.amount.precision <= 18 and self.amount.scale <= 6

    def units(self, value: Column) -> Column:
        return (value * F.lit(10**self.amount.scale)).cast("bigint") if self.split else value

    def names(self, name: str) -> list[str]:
        return [f"{name}_upper", f"{name}_lower"] if self.split else [name]

    def parts(self, name: str, units: Column) -> list[Column]:
        halves = [F.shiftright(units, 32), units.bitwiseAND(F.lit((1 << 32) - 1))] if self.split else [units]
        return [F.sum(part).alias(own) for part, own in zip(halves, self.names(name), strict=True)]

    def total(self, name: str) -> Column:
        if not self.split:
            return F.col(name)
        upper, lower = (F.col(own).cast("decimal(20,0)") for own in self.names(name))
        units = upper * F.lit(Decimal(1 << 32)) + lower
        digits = T.DecimalType(self.amount.precision + 10, self.amount.scale)
        return (units * F.lit(Decimal(1).scaleb(-self.amount.scale))).cast(digits)


def money_text(amount: Column) -> Column:
    """Two decimals at most, one at least: 10000.0, 12.5, 12.55."""
    fixed = F.round(amount, 2).cast(T.DecimalType(38, 2)).cast("string")
    return F.regexp_replace(fixed, "0$", "")


def day_text(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def details_text(parts: list[tuple[str, Column]]) -> Column:
    """``key=value;key=value`` in the given order."""
    pieces: list[Column] = []
    for i, (key, value) in enumerate(parts):
        pieces += [F.lit(f"{';' if i else ''}{key}="), value.cast("string")]
    return F.concat(*pieces)


def alert_day(details: Column | str) -> Column:
    """Day carried by the ``window=`` entry of an alert; NULL if unparsable."""
    text = F.regexp_extract(details, "window=([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return text.try_cast("date")
