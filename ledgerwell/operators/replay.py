"""The daily replay: one row a calendar day and account, one a day and holding, from the ledger's events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import BASE, MONEY, QTY, times_fx, times_price
from ledgerwell.functions.storage import stored
from ledgerwell.operators import ledger as lg
from ledgerwell.operators.asof import CARRIED, EXACT, carry_forward, first_seen


@dataclass
class Replay:
    holdings: DataFrame
    nav: DataFrame
    flows: DataFrame
    events: DataFrame
    prices: DataFrame | None = None


def running_quantities(events: DataFrame, start: str, end: str) -> DataFrame:
    """(account_id, ticker, as_of_date, quantity) for each day on which a holding isn't zero.

    A running sum over the few days with trades, then each level is spread over the days until the next trade: the
    window never sees the dense days.
    """
    by = Window.partitionBy("account_id", "ticker").orderBy("day")
    trades = events.filter("quantity is not null").groupBy("account_id", "ticker", "day").agg(F.sum("quantity").cast(QTY).alias("delta"))
    levels = trades.withColumn("quantity", F.sum("delta").over(by).cast(QTY)).withColumn("until", F.coalesce(F.date_sub(F.lead("day").over(by), 1), F.lit(end).cast("date")))
    levels = levels.filter("quantity <> 0").withColumn("from_", F.greatest("day", F.lit(start).cast("date"))).withColumn("to_", F.least("until", F.lit(end).cast("date"))).filter("from_ <= to_")
    return levels.select("account_id", "ticker", F.explode(F.sequence("from_", "to_")).alias("as_of_date"), "quantity")


def value_holdings(quantities: DataFrame, prices: DataFrame, fx_daily: DataFrame, instruments: DataFrame, max_price_stale_days: int) -> DataFrame:
    """Holdings with price, rate, values and valuation status; a price that is missing or stale wins over a missing rate."""
    daily = carry_forward(prices.select("ticker", F.col("price_date").alias("as_of_date"), "close_price"), ["ticker"], "as_of_date", max_price_stale_days).select("ticker", "as_of_date", "close_price", F.col("provenance").alias("price_provenance"))
    first_price = first_seen(prices, ["ticker"], "price_date").withColumnRenamed("first_seen", "first_price")
    rates = fx_daily.select(F.col("currency").alias("price_currency"), F.col("rate_date").alias("as_of_date"), "eur_per_unit", F.col("provenance").alias("fx_prov"))
    first_rate = first_seen(fx_daily.filter(F.col("provenance") == EXACT), ["currency"], "rate_date").select(F.col("currency").alias("price_currency"), F.col("first_seen").alias("first_rate"))
    h = quantities.join(instruments.select("ticker", F.upper("currency").alias("price_currency")), "ticker", "left").fillna({"price_currency": BASE})
    h = h.join(daily, ["ticker", "as_of_date"], "left").join(first_price, "ticker", "left").join(rates, ["price_currency", "as_of_date"], "left").join(first_rate, "price_currency", "left")
    base = F.col("price_currency") == BASE
    rate = F.when(base, F.lit(1).cast("decimal(18,12)")).otherwise(F.col("eur_per_unit").cast("decimal(18,12)"))
    fx_prov = F.when(base, F.lit(EXACT)).otherwise(F.col("fx_prov"))
    local = times_price(F.col("quantity"), F.col("close_price"))
    status = (
        F.when(F.col("close_price").isNull(), F.when(F.col("as_of_date") < F.coalesce("first_price", F.lit("9999-12-31").cast("date")), "MISSING_PRICE").otherwise("STALE_PRICE"))
        .when(rate.isNull(), F.when(F.col("as_of_date") < F.coalesce("first_rate", F.lit("9999-12-31").cast("date")), "MISSING_FX").otherwise("STALE_FX"))
        .when((F.col("price_provenance") == CARRIED) | (fx_prov == CARRIED), "FORWARD_FILL").otherwise("VALUED")
    )
    return h.select(
        "account_id", "as_of_date", "ticker", "quantity", "price_currency", "close_price", "price_provenance", F.when(F.col("close_price").isNotNull(), rate).alias("fx_rate_to_eur"),
        F.when(F.col("close_price").isNotNull() & rate.isNotNull(), fx_prov).alias("fx_provenance"), local.alias("market_value_local"), times_fx(local, rate).alias("market_value_eur"), status.alias("valuation_status"),
    )


def nav_rows(events: DataFrame, holdings: DataFrame, start: str, end: str) -> DataFrame:
    """One row an account and calendar day: running cash, securities, NAV (null if anything held has no value) and flows."""
    cash = lg.daily_cash(events.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    spine = events.select("account_id").distinct().select("account_id", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("as_of_date"))
    status = F.col("valuation_status")
    value = holdings.groupBy("account_id", "as_of_date").agg(
        F.sum("market_value_eur").cast(MONEY).alias("value"), F.count(F.when(status.isin("MISSING_PRICE", "STALE_PRICE"), 1)).alias("missing_price_count"),
        F.count(F.when(status.isin("MISSING_FX", "STALE_FX"), 1)).alias("missing_fx_count"), F.coalesce(F.bool_or(status == "FORWARD_FILL"), F.lit(False)).alias("carried"),
    )
    rows = spine.join(cash.withColumnRenamed("day", "as_of_date"), ["account_id", "as_of_date"], "left").join(value, ["account_id", "as_of_date"], "left")
    money = ["dividend_eur", "external_flow_eur", "internal_cash", "interest_eur", "fee_eur", "deposit_eur", "withdrawal_eur", "card_spending_eur", "cashback_eur", "trade_cash", "value"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in money} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("missing_price_count", "missing_fx_count")})
    internal = (F.col("dividend_eur") + F.col("trade_cash") + F.col("internal_cash")).cast(MONEY)
    running = F.sum(F.col("external_flow_eur") + F.col("internal_cash_flow_eur")).over(Window.partitionBy("account_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY)
    rows = rows.withColumn("internal_cash_flow_eur", internal).withColumn("cash_balance_eur", running)
    full = (F.col("missing_price_count") == 0) & (F.col("missing_fx_count") == 0)
    return rows.select(
        "account_id", "as_of_date", "cash_balance_eur", F.when(full, F.col("value")).alias("securities_value_eur"), F.when(full, F.col("cash_balance_eur") + F.col("value")).cast(MONEY).alias("nav_eur"),
        "external_flow_eur", "internal_cash_flow_eur", "dividend_eur", "interest_eur", "fee_eur", "deposit_eur", "withdrawal_eur", "card_spending_eur", "cashback_eur",
        F.when(~full, "PARTIAL").when(F.coalesce("carried", F.lit(False)), "FORWARD_FILL").otherwise("VALUED").alias("valuation_status"), "missing_price_count", "missing_fx_count",
    )


def replay(ledger: lg.Ledger, start: str, end: str, max_price_stale_days: int = 10, max_fx_stale_days: int = 10) -> Replay:
    return from_events(lg.ledger_events(ledger, lg.fx_daily(ledger.fx, max_fx_stale_days)), ledger, start, end, max_price_stale_days, max_fx_stale_days)


def from_events(events: DataFrame, ledger: lg.Ledger, start: str, end: str, max_price_stale_days: int = 10, max_fx_stale_days: int = 10) -> Replay:
    """The replay of events that ledger_events made of the ledger, for instance of its stored ones."""
    held = running_quantities(events, start, end)
    holdings = value_holdings(held, ledger.prices, lg.fx_daily(ledger.fx, max_fx_stale_days), ledger.instruments, max_price_stale_days)
    flows = lg.holding_flows(events).filter(F.col("as_of_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return Replay(holdings, nav_rows(events, holdings, start, end), flows, events, ledger.prices)


class Stored:
    """The replay's tables, each written when a report first asks for it; the NAV reads the written holdings."""

    def __init__(self, rep: Replay, start: str, end: str):
        self._rep, self._days, self.events, self.prices = rep, (start, end), rep.events, rep.prices

    @cached_property
    def holdings(self) -> DataFrame:
        return stored(self._rep.holdings, "holdings")

    @cached_property
    def nav(self) -> DataFrame:
        return stored(nav_rows(self.events, self.holdings, *self._days), "nav")

    @cached_property
    def flows(self) -> DataFrame:
        return stored(self._rep.flows, "flows")
