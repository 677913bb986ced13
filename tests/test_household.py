"""Spending buckets, rhythm, planning: small hand-worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import household as hh


def test_buckets_have_no_gaps(spark):
    rows = [("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 1, 4), 7.0), ("b", dt.date(2024, 1, 9), 1.0)]
    df = spark.createDataFrame(rows, "merchant string, day date, spent double")
    got = {(r.merchant, r.bucket.isoformat()): (r.spent, r.n) for r in hh.buckets(df, "merchant", "day").collect()}
    assert got == {("a", "2024-01-01"): (5.0, 1), ("a", "2024-01-02"): (0.0, 0), ("a", "2024-01-03"): (0.0, 0), ("a", "2024-01-04"): (7.0, 1), ("b", "2024-01-09"): (1.0, 1)}
    assert {r.bucket.isoformat() for r in hh.buckets(df, "merchant", "week").collect()} == {"2024-01-01", "2024-01-08"}
    assert hh.buckets(df.filter("false"), "merchant", "day").count() == 0


def test_rhythm_reads_the_last_gaps(spark):
    quarter = [("q", dt.date(2020, 1, 1) + dt.timedelta(days=91 * i)) for i in range(12)]
    df = spark.createDataFrame([*quarter, quarter[0], ("odd", dt.date(2020, 1, 1)), ("odd", dt.date(2020, 1, 11)), ("one", dt.date(2020, 1, 1))], "ticker string, day date")
    got = {r.ticker: r.per_year for r in hh.payment_rhythm(df, ["ticker"], "day").collect()}
    assert got == {"q": 4, "odd": None, "one": None}


def test_deposit_goes_by_shortfall(spark):
    positions = spark.createDataFrame([(1, "a", 600.0), (1, "b", 300.0), (1, "c", 100.0)], "account_id int, ticker string, value double")
    targets = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "ticker string, target double")
    got = {r.ticker: r.buy for r in hh.plan_allocation(positions, targets, 200).collect()}
    assert got == pytest.approx({"a": 200 * 240 / 260, "b": 0, "c": 200 * 20 / 260})


def test_future_values(spark):
    row = spark.range(1).select(hh.future_value(F.lit(1000.0), F.lit(0.0), F.lit(0.06), F.lit(12)).alias("a"), hh.future_value(F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(12)).alias("b"), hh.required_monthly(F.lit(0.0), F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("c"), hh.required_monthly(F.lit(1.0), F.lit(5.0), F.lit(0.1), F.lit(0)).alias("d")).first()
    assert row.a == pytest.approx(1060) and row.b == pytest.approx(1200) and row.c == pytest.approx(100) and row.d is None
