"""Exact money: the decimal types at rest and the one place where two of them are multiplied or divided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, QTY, FX = "decimal(28,10)", "decimal(28,10)", "decimal(18,12)"
BASE = "EUR"
ANNUAL = 365

#: Minor units, their currency and how many of them make one unit.
MINOR_UNITS = {"GBX": ("GBP", 100), "GBP_MINOR": ("GBP", 100), "ZAC": ("ZAR", 100), "ILA": ("ILS", 100)}


def times_price(quantity: Column, price: Column) -> Column:
    """quantity * price as MONEY, narrowed first so that no digit of the scale is lost."""
    return (quantity.cast("decimal(19,8)") * price.cast("decimal(18,8)")).cast(MONEY)


def times_fx(amount: Column, rate: Column) -> Column:
    """amount * rate as MONEY, for amounts and results below 10^17, rounded once.

    Whole units and the rest are multiplied apart: one exact product has 38 digits at amounts of 10^12.
    """
    amount, rate = amount.cast("decimal(26,8)"), rate.cast("decimal(17,12)")
    whole = amount.cast("decimal(18,0)")
    exact = lambda part: (part * rate).cast("decimal(37,20)")
    return (exact(whole) + exact((amount - whole).cast("decimal(9,8)"))).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is null or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def major_currency(code: Column) -> Column:
    out = F.upper(code)
    for minor, (major, _) in MINOR_UNITS.items():
        out = F.when(F.upper(code) == minor, F.lit(major)).otherwise(out)
    return out


def unit_divisor(code: Column) -> Column:
    out = F.lit(1)
    for minor, (_, divisor) in MINOR_UNITS.items():
        out = F.when(F.upper(code) == minor, F.lit(divisor)).otherwise(out)
    return out


def js_round(x: Column, digits: int = 2) -> Column:
    """Half up towards plus infinity, as dashboards round."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def money_out(x: Column, digits: int = 4) -> Column:
    """A decimal as a double, rounded while it is exact."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")
