"""Ledger events: admission and routing of fills, dividends and cash movements, and their daily rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import BASE, MONEY, QTY, times_fx
from ledgerwell.operators.asof import carry_forward, eur_rate

#: The types of cash movements.
EXTERNAL_TYPES = ("DEPOSIT", "WITHDRAWAL", "WITHDRAW", "TRANSFER_IN", "TRANSFER_OUT", "CASH_TRANSFER")
INTERNAL_TYPES = ("FEE", "INTEREST_ON_FREE_CASH", "INTEREST")
OUT_TYPES, IN_TYPES = ("WITHDRAW", "WITHDRAWAL"), ("DEPOSIT",)


@dataclass
class Ledger:
    """fills(account_id, fill_id, fill_timestamp, ticker, side, fill_type, quantity, net_value, currency),
    dividends(account_id, ticker, paid_on, amount, currency, amount_in_euro),
    cash(account_id, reference, ts, transaction_type, currency, amount, action), prices(ticker, price_date, close_price),
    fx(currency, rate_date, eur_per_unit), instruments(ticker, currency)."""

    fills: DataFrame
    dividends: DataFrame
    cash: DataFrame
    prices: DataFrame
    fx: DataFrame
    instruments: DataFrame


def admitted(fills: DataFrame) -> Column:
    return (F.col("fill_type") == "TRADE") & F.col("side").isin("BUY", "SELL") & F.col("quantity").isNotNull()


def unsupported_tickers(fills: DataFrame) -> DataFrame:
    """Tickers of fills that the replay can't use."""
    return fills.filter("ticker is not null and fill_timestamp is not null").filter(~F.coalesce(admitted(fills), F.lit(False))).select("ticker").distinct()


def signed_quantity(side: Column, quantity: Column) -> Column:
    """The side alone decides the direction; the sign of a quantity is ignored."""
    return F.abs(quantity) * F.when(side == "BUY", 1).otherwise(-1)


def card_label(action: Column) -> Column:
    a = F.lower(F.trim(action))
    return F.when(F.contains(a, F.lit("cashback")), "cashback").when(F.startswith(a, F.lit("card ")), "card")


def conversion_legs(cash: DataFrame) -> DataFrame:
    """(account_id, reference) of currency conversions: at one instant money leaves in some currencies and comes in others."""
    kind, code = F.upper(F.coalesce("transaction_type", F.lit(""))), F.upper(F.coalesce("currency", F.lit("")))
    legs = cash.filter("ts is not null and amount is not null").withColumn("way", F.when(kind.isin(*OUT_TYPES), "out").when(kind.isin(*IN_TYPES), "in")).filter("way is not null")
    # most instants have one way only: they are left out before anything of them is collected
    instant = Window.partitionBy("account_id", "ts")
    legs = legs.withColumns({"out_": F.max(F.col("way") == "out").over(instant), "in_": F.max(F.col("way") == "in").over(instant)}).filter("out_ and in_")
    at = legs.groupBy("account_id", "ts").agg(
        F.collect_set(F.when(F.col("way") == "out", code)).alias("outs"), F.collect_set(F.when(F.col("way") == "in", code)).alias("ins"), F.collect_set("reference").alias("references"),
    )
    return at.filter(~F.arrays_overlap("outs", "ins")).select("account_id", F.explode("references").alias("reference"))


def to_eur(df: DataFrame, amount: str, currency: str, day: str, fx_daily: DataFrame, name: str = "eur") -> DataFrame:
    """df with the amount in EUR at the rate carried to the day; null where there is none within the cutoff."""
    code = F.upper(F.coalesce(F.col(currency), F.lit(BASE)))
    rates = fx_daily.select(F.col("currency").alias("fx_code"), F.col("rate_date").alias("fx_day"), "eur_per_unit")
    joined = df.withColumn("code_", code).join(rates, (F.col("code_") == F.col("fx_code")) & (F.col(day) == F.col("fx_day")), "left")
    return joined.withColumn(name, times_fx(F.col(amount), eur_rate(F.col("code_"), F.col("eur_per_unit")))).drop("fx_code", "fx_day", "eur_per_unit")


def route_cash(cash: DataFrame, fx_daily: DataFrame) -> DataFrame:
    """Cash movements with eur and flow_class: excluded, conversion, cashback, card, external, interest, fee, dividend, ignored.

    Order matters: what can't be converted is excluded before anything else, dividend rows are left to the dividend
    ledger, an unknown label stays an external flow. Legs of conversions are found here unless cash has is_leg.
    """
    kind = F.upper(F.coalesce("transaction_type", F.lit("")))
    rows = to_eur(cash.filter("ts is not null and amount is not null").withColumn("day", F.to_date("ts")), "amount", "currency", "day", fx_daily)
    if "is_leg" not in cash.columns:
        rows = rows.join(conversion_legs(cash).withColumn("is_leg", F.lit(True)), ["account_id", "reference"], "left")
    label = card_label(F.coalesce("action", F.lit("")))
    external, internal = kind.isin(*EXTERNAL_TYPES), kind.isin(*INTERNAL_TYPES)
    flow_class = (
        F.when((external | internal) & F.col("eur").isNull(), "excluded")
        .when(external & F.col("is_leg"), "conversion").when(external & (label == "cashback"), "cashback").when(external & (label == "card"), "card")
        .when(external, "external").when(internal & (kind == "FEE"), "fee").when(internal, "interest").when(F.contains(kind, F.lit("DIVIDEND")), "dividend").otherwise("ignored")
    )
    return rows.withColumn("flow_class", flow_class).drop("is_leg", "code_")


def _sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast(MONEY)


def ledger_events(ledger: Ledger, fx_daily: DataFrame) -> DataFrame:
    """One row an event: (account_id, day, ticker, kind, quantity, eur), kind being buy, sell, dividend or a flow class."""
    fills = ledger.fills.filter("ticker is not null and fill_timestamp is not null").filter(admitted(ledger.fills)).withColumn("day", F.to_date("fill_timestamp"))
    fills = to_eur(fills, "net_value", "currency", "day", fx_daily).select("account_id", "day", "ticker", F.lower("side").alias("kind"), signed_quantity(F.col("side"), F.col("quantity")).cast(QTY).alias("quantity"), "eur")
    dividends = to_eur(ledger.dividends.filter("paid_on is not null").withColumn("day", F.to_date("paid_on")), "amount", "currency", "day", fx_daily)
    dividends = dividends.select("account_id", "day", "ticker", F.lit("dividend").alias("kind"), F.lit(None).cast(QTY).alias("quantity"), F.coalesce("amount_in_euro", "eur").cast(MONEY).alias("eur"))
    cash = route_cash(ledger.cash, fx_daily).filter("flow_class not in ('excluded', 'dividend', 'ignored')").select("account_id", "day", F.lit(None).cast("string").alias("ticker"), F.concat(F.lit("cash_"), "flow_class").alias("kind"), F.lit(None).cast(QTY).alias("quantity"), "eur")
    return fills.unionByName(dividends).unionByName(cash)


def daily_events(events: DataFrame) -> DataFrame:
    """events summed up by account, day, ticker and kind: as good for every daily sum, and as few as days and holdings.

    Amounts in and out, unknown ones and rows with and without a quantity stay apart.
    """
    apart = [(F.col("eur") >= 0).alias("in_"), F.col("quantity").isNotNull().alias("traded_")]
    sums = events.groupBy("account_id", "day", "ticker", "kind", *apart).agg(F.sum("quantity").cast(QTY).alias("quantity"), F.sum("eur").cast(MONEY).alias("eur"))
    return sums.select("account_id", "day", "ticker", "kind", "quantity", "eur")


def daily_cash(events: DataFrame) -> DataFrame:
    """Cash by account and day, split into its parts."""
    kind, eur = F.col("kind"), F.col("eur")
    external = kind.isin("cash_external", "cash_card")
    return events.groupBy("account_id", "day").agg(
        _sum(kind == "sell", eur).alias("sold"), _sum(kind == "buy", eur).alias("bought"), _sum(kind == "dividend", eur).alias("dividend_eur"),
        _sum(external, eur).alias("external_flow_eur"), _sum(kind.isin("cash_conversion", "cash_cashback", "cash_fee", "cash_interest"), eur).alias("internal_cash"),
        _sum(kind == "cash_interest", eur).alias("interest_eur"), _sum(kind == "cash_fee", eur).alias("fee_eur"), _sum(external & (eur >= 0), eur).alias("deposit_eur"),
        _sum(external & (eur < 0), eur).alias("withdrawal_eur"), _sum(kind == "cash_card", eur).alias("card_spending_eur"), _sum(kind == "cash_cashback", eur).alias("cashback_eur"),
    ).withColumn("trade_cash", (F.col("sold") - F.col("bought")).cast(MONEY))


def holding_flows(events: DataFrame) -> DataFrame:
    """(account_id, as_of_date, ticker, bought_eur, sold_eur, dividend_eur) of days with a converted flow."""
    kind, eur = F.col("kind"), F.col("eur")
    rows = events.filter("ticker is not null and eur is not null")
    return rows.groupBy("account_id", F.col("day").alias("as_of_date"), "ticker").agg(_sum(kind == "buy", eur).alias("bought_eur"), _sum(kind == "sell", eur).alias("sold_eur"), _sum(kind == "dividend", eur).alias("dividend_eur"))


def fx_daily(fx: DataFrame, max_stale_days: int) -> DataFrame:
    return carry_forward(fx.withColumn("currency", F.upper("currency")), ["currency"], "rate_date", max_stale_days)


def required_currencies(ledger: Ledger) -> DataFrame:
    """Distinct upper-cased currencies other than the base that the ledger needs rates for."""
    codes = [ledger.fills.select("currency"), ledger.dividends.filter("amount_in_euro is null").select("currency"), ledger.cash.select("currency"), ledger.instruments.select("currency")]
    out = codes[0]
    for c in codes[1:]:
        out = out.unionByName(c)
    return out.select(F.upper("currency").alias("currency")).filter(f"currency is not null and currency <> '{BASE}'").distinct()


def first_event_date(ledger: Ledger) -> DataFrame:
    days = ledger.fills.select("account_id", F.to_date("fill_timestamp").alias("day")).unionByName(ledger.dividends.select("account_id", F.to_date("paid_on").alias("day"))).unionByName(ledger.cash.select("account_id", F.to_date("ts").alias("day")))
    return days.groupBy("account_id").agg(F.min("day").alias("first_day"))
