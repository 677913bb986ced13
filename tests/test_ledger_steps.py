"""The ledger of the given tables: sums of a day against its rows, and how its tables are joined."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerwell.functions.money import times_fx
from ledgerwell.operators import ledger as lg
from ledgerwell.operators import replay as rp
from ledgerwell.plans import adapters as ad
from ledgerwell.plans import portfolio as pf

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Two days of lines of every odd kind: without part, order, quantity, discount, tax or day, of no quantity, and below zero."""
    out = tmp_path_factory.mktemp("tables")
    first, second = dt.datetime(1996, 5, 6), dt.datetime(1996, 5, 9)
    lines = [
        (1, 1, 1, 3.0, 90.5, 0.1, 0.02, "N", first), (1, 1, 2, 4.0, 80.25, 0.05, 0.04, "A", first), (2, 2, 2, 5.0, 99.0, 0.0, 0.08, "A", first), (2, 1, 2, 1.0, 10.0, 0.0, None, "A", first), (1, 1, 3, 2.0, 70.0, 0.0, 0.0, "R", first),
        (9, 1, 1, 1.0, 400.0, 0.0, 0.0, "N", first), (1, 9, 1, 1.0, 900.0, 0.0, 0.0, "N", first), (1, 1, 1, None, 50.0, 0.0, 0.0, "N", second), (1, 1, 1, 2.0, 60.0, None, 0.0, "N", second), (1, 1, 1, 2.0, 44.0, 0.0, 0.0, "N", second),
        (1, 2, 1, 0.0, 60.0, 0.0, 0.0, "N", second), (3, 2, 1, -2.0, 60.0, 0.0, 0.0, "N", second), (3, 2, 1, 6.0, -60.0, 0.0, 0.0, "N", second), (3, 2, 2, 6.0, None, 0.0, 0.0, "A", second), (3, 2, 1, 7.0, 70.0, 0.0, 0.0, "N", None),
    ]
    tables = {
        "lineitem": (lines, LINE), "part": ([(1, "Brand#11"), (2, "Brand#13")], "p_partkey long, p_brand string"), "customer": ([(1, "BUILDING"), (2, "MACHINERY")], "c_custkey long, c_mktsegment string"),
        "orders": ([(1, 1, first), (2, 2, first), (3, 2, second)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "events": ([(487 + i, i, k, 3.5, first) for i, k in enumerate(["signup", "purchase", "view", "click", "error", "purchase"])], "event_id long, user_id long, event_type string, value double, ts timestamp"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_a_days_sums_are_as_good_as_its_rows(spark, sf_dir):
    def events(led):
        e = lg.daily_events(lg.ledger_events(led, lg.fx_daily(led.fx, 10)))
        return sorted(map(str, e.groupBy("account_id", "day", "ticker", "kind").agg(F.sum("quantity").cast("decimal(28,4)"), F.sum("eur").cast("decimal(28,4)")).collect()))

    rows, sums = ad.ledger(spark, sf_dir), ad.summed_ledger(spark, sf_dir)
    assert len(events(rows)) > 10 and events(sums) == events(rows)
    prices = lambda led: sorted(map(str, led.prices.collect()))
    assert len(prices(rows)) == 5 and prices(sums) == prices(rows)
    first = lambda led: sorted(map(str, lg.first_event_date(led).collect()))
    assert first(sums) == first(rows)


def test_the_replay_reads_lines_once(spark, sf_dir):
    rep = pf.computed(spark, sf_dir)
    assert rep.holdings.count() and rep.nav.count()
    assert not [f for part in (rep.holdings, rep.nav, rep.flows, rep.prices) for f in part.inputFiles() if f"{sf_dir}/lineitem" in f or f"{sf_dir}/orders" in f]


@pytest.mark.parametrize("name", ["v_fills", "v_dividends", "v_prices", "v_positions"])
def test_large_tables_of_small_files_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    plan = lambda: ad.view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(ad, "BROADCAST_ROWS", 10)
    assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()


def test_hundredths_are_those_of_the_cast(spark):
    odd = [0.1, 0.005, 0.015, 1.005, 2.675, -2.675, 123456.785, 100000000.015, 999999999.99, 1000000000.01, 99999999999.99, 1e-9, -0.0, 0.0, 33.333333, 0.285, None]
    rows = spark.createDataFrame([(v,) for v in odd], "v double").selectExpr("v", f"{ad._hundredths('v', 'DECIMAL(14,2)')} AS n", "CAST(CAST(v AS DECIMAL(14,2)) * 100 AS BIGINT) AS cast_").collect()
    assert [r.n for r in rows] == [r.cast_ for r in rows]


def test_lines_meet_their_keys_without_a_sort(spark, sf_dir, monkeypatch):
    plans = {}
    monkeypatch.setattr(ad, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ad, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and df)
    ad.summed_ledger(spark, sf_dir)
    assert "ShuffledHashJoin" in plans["trades"] and "SortMergeJoin" not in plans["trades"] and "BroadcastHashJoin" not in plans["trades"]


def test_a_report_writes_only_the_tables_it_reads(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(rp, "stored", lambda df, name: written.append(name) or df)
    rep = rp.Stored(pf.computed(spark, sf_dir), ad.START, ad.END)
    assert rep.holdings.columns and rep.holdings.columns and written == ["holdings"]
    assert rep.nav.columns and written == ["holdings", "nav"]


def test_cash_of_a_day_is_as_good_as_its_rows(spark, sf_dir, tmp_path):
    for name in ("lineitem", "part", "customer", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    values = [3.005, 0.125, None, -2.5, 9999999.995, 0.0]
    moves = [(487 + day + 2500 * i, 5 * i, kind, v, None) for day in (0, 1) for i, v in enumerate(values) for kind in ("signup", "purchase", "view", "click", "error")]
    spark.createDataFrame(moves, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")

    def sums(led):
        e = lg.daily_events(lg.ledger_events(led, lg.fx_daily(led.fx, 10))).filter("ticker is null")
        return sorted(map(str, e.groupBy("account_id", "day", "kind", (F.col("eur") >= 0).alias("in_")).agg(F.sum("eur")).collect()))

    rows, whole = ad.ledger(spark, str(tmp_path)), ad.summed_ledger(spark, str(tmp_path))
    assert len(sums(rows)) > 8 and sums(whole) == sums(rows)
    assert rows.cash.count() == 60 and whole.cash.count() <= 30
    assert sorted(map(str, lg.first_event_date(whole).collect())) == sorted(map(str, lg.first_event_date(rows).collect()))


def test_legs_that_are_known_are_not_searched_again(spark):
    at = [dt.datetime(1996, 5, 6, 12), dt.datetime(1996, 5, 6, 13)]
    moves = [
        ("a", "1", at[0], "WITHDRAW", "EUR", "5"), ("a", "2", at[0], "DEPOSIT", "USD", "5"), ("a", "3", at[1], "DEPOSIT", "USD", "5"), ("b", "4", at[0], "DEPOSIT", "USD", "5"),
        ("b", "5", at[1], "DEPOSIT", "EUR", "5"), ("b", "6", at[1], "WITHDRAW", "EUR", "5"), ("b", "7", None, "WITHDRAW", "EUR", "5"), ("c", "8", at[0], "WITHDRAWAL", "EUR", None), ("c", "9", at[0], "DEPOSIT", "USD", "5"),
    ]
    cash = spark.createDataFrame(moves, "account_id string, reference string, ts timestamp, transaction_type string, currency string, amount string")
    cash = cash.withColumn("amount", F.col("amount").cast("decimal(28,10)")).withColumn("action", F.lit(""))
    legs = lg.conversion_legs(cash)
    assert sorted(map(tuple, legs.collect())) == [("a", "1"), ("a", "2")]
    rates = lg.fx_daily(spark.createDataFrame([("USD", at[0].date(), "0.9")], "currency string, rate_date date, r string").select("currency", "rate_date", F.col("r").cast("decimal(8,4)").alias("eur_per_unit")), 10)
    routed = lambda c: sorted(map(str, lg.route_cash(c, rates).select("account_id", "reference", "flow_class", "eur").collect()))
    known = cash.join(legs.withColumn("is_leg", F.lit(True)), ["account_id", "reference"], "left")
    assert routed(known) == routed(cash) and sum("conversion" in r for r in routed(cash)) == 2


def test_amounts_above_a_million_millions_are_converted_exactly(spark):
    pairs = [("1004387736567.6", "0.8741"), ("-93517384920175.12345678", "1.234567891234"), ("99999999999999999", "0.9999"), ("999999999999.99999999", "0.999999999999"), ("0.5", "0.000000000100"), ("-7.00000001", "33333.000000005"), ("12.3", None)]
    rows = spark.createDataFrame(pairs, "a string, r string").select("a", "r", times_fx(F.col("a").cast("decimal(28,10)"), F.col("r").cast("decimal(18,12)")).alias("eur")).collect()
    with localcontext(prec=60):
        want = [r.r and (Decimal(r.a) * Decimal(r.r)).quantize(Decimal("1e-10"), ROUND_HALF_UP) for r in rows]
    assert [r.eur for r in rows] == want


@pytest.fixture(scope="module")
def dear(spark, sf_dir, tmp_path_factory):
    """As at 360 copies of the given tables: many shares at a high price, where only the value has so many digits."""
    out, day = tmp_path_factory.mktemp("dear"), dt.datetime(1996, 5, 6)
    for table in ("part", "customer", "orders", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{out}/{table}.parquet")
    lines = spark.createDataFrame([(1, 1, 1, 5e7, 100.0, 0.0, 0.0, "N", day), (1, 1, 1, 1.0, 900000.0, 0.0, 0.0, "N", day)], LINE)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").unionByName(lines).write.parquet(f"{out}/lineitem.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["win09_invested_to_date", "join20_nav_and_passive", "agg17_brinson", "agg20_clusters", "win14_latest_snapshot"])
def test_holdings_may_be_worth_more_than_a_million_millions(spark, dear, name):
    assert __spark_entry__.queries()[name](spark, dear).collect() is not None
    assert pf.replayed(spark, dear).holdings.agg(F.max("market_value_eur")).head()[0] > 10**12
