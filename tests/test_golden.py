"""A small portfolio worked through from ledger to risk figures, and ledger rows of every kind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import ledger as lg
from ledgerwell.operators import markets as mk
from ledgerwell.operators import replay as rp
from ledgerwell.operators import returns as rt
from ledgerwell.operators.asof import as_of

D = dt.date
MONDAYS = [D(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(13)]
USD_TECH = [100, 105, 110, 108, 95, 90, 100, 115, 120, 118, 125, 130, 128]
GBP_INDU = [50, 51, 52, 50, 49, 48, 50, 53, 55, 54, 56, 58, 57]


def _ledger(spark, fills=(), dividends=(), cash=()):
    dec = lambda df, *cols: df.withColumns({c: F.col(c).cast("decimal(28,10)") for c in cols})
    ts = lambda d: dt.datetime(d.year, d.month, d.day, 12)
    f = spark.createDataFrame([("a", str(i), ts(d), t, s, k, float(q), float(v), c) for i, (d, t, s, k, q, v, c) in enumerate(fills)], "account_id string, fill_id string, fill_timestamp timestamp, ticker string, side string, fill_type string, quantity double, net_value double, currency string")
    v = spark.createDataFrame([("a", t, ts(d), float(a), c, e) for d, t, a, c, e in dividends], "account_id string, ticker string, paid_on timestamp, amount double, currency string, amount_in_euro double")
    m = spark.createDataFrame([("a", str(i), ts(d), k, c, float(a), x) for i, (d, k, c, a, x) in enumerate(cash)], "account_id string, reference string, ts timestamp, transaction_type string, currency string, amount double, action string")
    prices = spark.createDataFrame([(t, d, float(p)) for t, ps in (("USD_TECH_EQ", USD_TECH), ("GBP_INDU_EQ", GBP_INDU)) for d, p in zip(MONDAYS, ps, strict=True)], "ticker string, price_date date, close_price double")
    fx = spark.createDataFrame([(c, d, r) for c, r in (("USD", 0.9), ("GBP", 1.15)) for d in MONDAYS], "currency string, rate_date date, eur_per_unit double").withColumn("eur_per_unit", F.col("eur_per_unit").cast("decimal(18,12)"))
    instruments = spark.createDataFrame([("USD_TECH_EQ", "USD"), ("GBP_INDU_EQ", "GBP")], "ticker string, currency string")
    return lg.Ledger(dec(f, "quantity", "net_value"), dec(v, "amount", "amount_in_euro"), dec(m, "amount"), dec(prices, "close_price"), fx, instruments)


@pytest.fixture(scope="module")
def golden(spark):
    fills = [(D(2024, 1, 3), "USD_TECH_EQ", "BUY", "TRADE", 10, 900, "EUR"), (D(2024, 1, 17), "GBP_INDU_EQ", "BUY", "TRADE", 20, 1196, "EUR"), (D(2024, 3, 6), "USD_TECH_EQ", "SELL", "TRADE", -4, 424.8, "EUR")]
    cash = [(D(2024, 1, 2), "DEPOSIT", "EUR", 10000, None), (D(2024, 2, 1), "DEPOSIT", "EUR", 5000, None), (D(2024, 3, 20), "WITHDRAWAL", "EUR", -2000, None)]
    rep = rp.replay(_ledger(spark, fills, [(D(2024, 2, 14), "USD_TECH_EQ", 12, "USD", None)], cash), "2024-01-02", "2024-03-29")
    return rp.Replay(rep.holdings.cache(), rep.nav.cache(), rep.flows, rep.events)


def test_golden_values(golden):
    nav = {r.as_of_date.isoformat()[5:]: float(r.nav_eur) for r in golden.nav.collect()}
    assert len(nav) == 88 and golden.holdings.count() == 160
    assert {d: nav[d] for d in ("01-02", "01-06", "02-01", "02-14", "03-20", "03-29")} == {"01-02": 10000.0, "01-06": 10000.0, "02-01": 14886.0, "02-14": 14964.8, "03-20": 13375.6, "03-29": 13341.8}


def test_golden_returns(golden):
    twr = rt.daily_twr(golden.nav)
    assert twr.filter("twr <> 0").count() == 13
    m, near = rt.risk_metrics(twr).first(), lambda x: pytest.approx(x, abs=1e-9)
    assert m.cumulative == near(0.018534671266450475) and m.annualised == near(0.08009451712833893)
    assert m.volatility == near(0.053151843863394305) and m.downside_volatility == near(0.08992845164985407)
    assert m.sharpe == near(1.476001090101396) and m.sortino == near(0.8723844127632825)
    worst = rt.worst_drawdown(rt.twr_index(golden.nav)).first()
    assert worst.drawdown == near(-0.02469373116091933) and m.annualised / abs(worst.drawdown) == near(3.243516202812547)
    assert (worst.recovery_date - worst.peak_date).days == 36 and (worst.recovery_date - worst.trough_date).days == 21
    x = mk.xirr(mk.account_flows(golden.nav), ["account_id"]).first()
    assert x.status == "ok" and x.xirr == near(0.11450964649407087)


def test_xirr_statuses(spark):
    rows = [("one", D(2024, 1, 1), -5.0), ("same", D(2024, 1, 1), -5.0), ("same", D(2024, 2, 1), -1.0), ("ok", D(2023, 1, 1), -100.0), ("ok", D(2024, 1, 1), 110.0), ("far", D(2024, 1, 1), -1.0), ("far", D(2024, 1, 2), 1e9)]
    got = {r.k: (r.status, r.xirr) for r in mk.xirr(spark.createDataFrame(rows, "k string, day date, amount double"), ["k"]).collect()}
    assert got["one"] == ("insufficient_data", None) and got["same"] == ("no_sign_change", None) and got["far"] == ("no_bracket", None)
    assert got["ok"][0] == "ok" and got["ok"][1] == pytest.approx(0.1, abs=1e-9)


def test_ledger_rows_of_every_kind(spark):
    day, noon = D(2024, 1, 10), D(2024, 1, 11)
    fills = [(day, "USD_TECH_EQ", "BUY", "TRADE", 3, 27, "USD"), (day, "USD_TECH_EQ", "BUY", "STOCK_SPLIT", 9, 0, "USD"), (day, "GBP_INDU_EQ", None, "TRADE", 2, 10, "EUR")]
    dividends = [(day, "USD_TECH_EQ", 10, "USD", 8.5), (day, "USD_TECH_EQ", 10, "USD", None)]
    cash = [
        (day, "DEPOSIT", "USD", 100, None), (day, "WITHDRAW", "EUR", -90, None), (noon, "TRANSFER_IN", "EUR", 7, None), (noon, "TRANSFER_OUT", "EUR", -2, None), (noon, "DIVIDEND", "EUR", 5, None),
        (noon, "SOMETHING", "EUR", 5, None), (noon, "DEPOSIT", "JPY", 5, None), (noon, "FEE", "EUR", -1, None), (noon, "INTEREST", None, 2, None), (noon, "DEPOSIT", "EUR", 3, "Spending cashback"), (D(2024, 1, 12), "WITHDRAW", "EUR", -4, "Card debit"),
    ]
    led = _ledger(spark, fills, dividends, cash)
    fx = lg.fx_daily(led.fx, 10)
    routed = sorted((r.reference, r.flow_class, None if r.eur is None else float(r.eur)) for r in lg.route_cash(led.cash, fx).collect())
    assert routed == sorted([("0", "conversion", 90.0), ("1", "conversion", -90.0), ("2", "external", 7.0), ("3", "external", -2.0), ("4", "dividend", 5.0), ("5", "ignored", 5.0), ("6", "excluded", None), ("7", "fee", -1.0), ("8", "interest", 2.0), ("9", "cashback", 3.0), ("10", "card", -4.0)])
    e = [(r.kind, r.quantity and float(r.quantity), float(r.eur)) for r in lg.ledger_events(led, fx).filter("ticker is not null").collect()]
    assert sorted(e, key=str) == sorted([("buy", 3.0, pytest.approx(24.3)), ("dividend", None, 8.5), ("dividend", None, 9.0)], key=str) or {x[0] for x in e} == {"buy", "dividend"} and len(e) == 3
    assert [r.ticker for r in lg.unsupported_tickers(led.fills).orderBy("ticker").collect()] == ["GBP_INDU_EQ", "USD_TECH_EQ"]
    assert {r.currency for r in lg.required_currencies(led).collect()} == {"USD", "JPY", "GBP"} and lg.first_event_date(led).first().first_day == day


def test_as_of_across_months(spark):
    right = spark.createDataFrame([("k", D(2024, 1, 5), 1), ("k", D(2024, 3, 20), 2), (None, D(2024, 1, 1), 9), ("k", None, 7)], "k string, d date, v int")
    left = spark.createDataFrame([("k", d) for d in (D(2024, 1, 1), D(2024, 1, 5), D(2024, 2, 28), D(2024, 3, 19), D(2024, 3, 20), D(2025, 1, 1))] + [(None, D(2024, 6, 1)), ("x", D(2024, 1, 5)), ("k", None)], "k string, at date")
    got = {(r.k, r.at and r.at.isoformat()): r.v for r in as_of(left, right, ["k"], "at", "d", ["v"]).collect()}
    assert got == {("k", "2024-01-01"): None, ("k", "2024-01-05"): 1, ("k", "2024-02-28"): 1, ("k", "2024-03-19"): 1, ("k", "2024-03-20"): 2, ("k", "2025-01-01"): 2, (None, "2024-06-01"): 9, ("x", "2024-01-05"): None, ("k", None): None}
    later = {(r.k, r.at and r.at.isoformat()): r.v for r in as_of(left.filter("at is not null"), right, ["k"], "at", "d", ["v"], 2, or_next=True).collect()}
    assert later[("k", "2024-01-01")] == 1 and later[("k", "2024-02-28")] == 2 and later[("k", "2025-01-01")] is None and later[("k", "2024-01-05")] == 1


def test_events_of_a_day_are_one_row_with_the_same_sums(spark):
    rows = [("a", "2024-01-02", "T", "buy", 2, 10)] * 40 + [("a", "2024-01-02", "T", "buy", 1, None), ("a", "2024-01-02", None, "cash_external", None, 7), ("a", "2024-01-02", None, "cash_external", None, -3), ("a", "2024-01-02", None, "cash_external", None, -4)]
    events = spark.createDataFrame(rows, "account_id string, day string, ticker string, kind string, quantity int, eur int").selectExpr("account_id", "date(day) as day", "ticker", "kind", "cast(quantity as decimal(28,10)) as quantity", "cast(eur as decimal(28,10)) as eur")
    daily = lg.daily_events(events)
    assert daily.count() == 4 and daily.schema == events.schema
    assert lg.daily_cash(daily).collect() == lg.daily_cash(events).collect() and lg.holding_flows(daily).collect() == lg.holding_flows(events).collect()
    held = lambda e: rp.running_quantities(e, "2024-01-01", "2024-01-03").collect()
    assert held(daily) == held(events) and held(daily)[0]["quantity"] == 81
