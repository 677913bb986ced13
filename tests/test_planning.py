"""Charges that recur, ranges of values, figures and exposure on small cases."""

import datetime as dt
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import companies as co
from ledgerwell.operators import planning as pl
from ledgerwell.operators import requests as rq
from ledgerwell.sources import raw


def _charges(spark, rows):
    return spark.createDataFrame([(1, m, dt.datetime.fromisoformat(t), a) for m, t, a in rows], "card int, merchant string, ts timestamp, amount double")


def test_recurring_charges(spark):
    rows = [("video", f"2024-{m:02d}-31T08:00:00" if m in (1, 3, 5) else f"2024-{m:02d}-28T08:00:00", 10.0) for m in range(1, 5)] + [("video", "2024-05-28T08:00:00", 11.0)]
    rows += [("video", f"2024-0{m}-10T00:00:00", 50.0) for m in (1, 2, 3)]  # another amount is another charge, ended
    rows += [("gym", f"2024-05-{d:02d}T00:00:00", 7.5) for d in (1, 8, 15, 22, 29)]
    rows += [("shop", "2024-05-01T00:00:00", 3.0), ("shop", "2024-05-02T00:00:00", 3.0), ("shop", "2024-06-01T00:00:00", 3.0), ("once", "2024-05-01T00:00:00", 3.0)]
    rows += [("club", "2023-05-31T00:00:00", 99.0), ("club", "2024-05-30T00:00:00", 99.0), ("app", "2024-04-30T00:00:00", 2.0), ("app", "2024-05-31T00:00:00", 2.0)]
    rows += [("odd", "2024-05-01T00:00:00", -4.0), ("odd", "2024-05-31T00:00:00", -4.0)]
    got = {(r.merchant, r.amount): r for r in pl.recurring(_charges(spark, rows), ["card", "merchant"], "2024-06-02").collect()}
    assert sorted(got) == [("app", 2.0), ("club", 99.0), ("gym", 7.5), ("video", 11.0), ("video", 50.0)]
    assert [got[k].status for k in sorted(got)] == ["new", "new", "active", "price-up", "lapsed"]
    assert [got[k].cadence for k in sorted(got)] == ["Monthly", "Yearly", "Weekly", "Monthly", "Monthly"]
    video, app = got["video", 11.0], got["app", 2.0]
    assert (video.previous_amount, video.n, video.monthly_cost, video.next) == (10.0, 5, 11.0, dt.datetime(2024, 6, 28, 8))
    assert app.next == dt.datetime(2024, 7, 1) and got["gym", 7.5].monthly_cost == 32.5 and got["club", 99.0].next == dt.datetime(2025, 5, 30)
    assert pl.recurring(_charges(spark, []), ["card", "merchant"], "2024-06-02").count() == 0


def _uniform(seed):
    state = seed
    while True:
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ (state >> 15)) * (state | 1) % 2**32
        t ^= (t + (t ^ (t >> 7)) * (t | 61) % 2**32) % 2**32
        yield ((t ^ (t >> 14)) % 2**32) / 2**32


def test_ranges_follow_one_sequence_of_draws(spark):
    paths, months, seed = 37, 7, 11
    uniform, sigma = _uniform(seed), 0.2 / math.sqrt(12)
    mu, values, want = math.log(1.05) / 12 - sigma * sigma / 2, [1000.0] * paths, []
    for _ in range(months):
        for p in range(paths):
            u, v = max(next(uniform), 1e-12), next(uniform)
            values[p] = values[p] * math.exp(mu + sigma * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)) + 50
        s, at = sorted(values), (paths - 1) * 0.1
        want.append((s[3] + (s[4] - s[3]) * (at - 3), s[18]))
    plans = spark.createDataFrame([("a", 1000.0, 50.0, 0.05, 0.2, months / 12)], "id string, start double, monthly double, yearly double, volatility double, years double")
    got = sorted(pl.value_ranges(plans, "id", paths, seed).collect(), key=lambda r: r.month)
    assert len(got) == months + 1 and (got[0].low, got[0].high, got[7].contributed) == (1000.0, 1000.0, 1350.0)
    assert [(r.low, r.median) for r in got[1:]] == [pytest.approx(w, rel=1e-12) for w in want]


def _fact(start, end, val, filed="2024-12-31", metric="revenue"):
    return (1, metric, start and dt.date.fromisoformat(start), dt.date.fromisoformat(end), float(val), dt.date.fromisoformat(filed))


def _facts(spark, rows):
    return spark.createDataFrame(rows, "c int, metric string, start date, end date, val double, filed date")


def test_trailing_year_and_quarters(spark):
    year, half, prior = _fact("2023-01-01", "2023-12-31", 100), _fact("2024-01-01", "2024-06-30", 60), _fact("2023-01-01", "2023-06-30", 45)
    ttm = lambda rows: [(r.ttm, str(r.ttm_end)) for r in co.trailing_year(_facts(spark, rows), ["c", "metric"]).collect()]
    assert ttm([year]) == ttm([year, prior]) == [(100.0, "2023-12-31")]
    assert ttm([year, half, prior]) == [(115.0, "2024-06-30")]
    assert ttm([year, half]) == [(100.0, "2023-12-31")] and ttm([half]) == ttm([_fact(None, "2024-01-01", 1)]) == []
    quarters = [_fact("2024-01-01", "2024-03-31", 1), _fact("2024-04-01", "2024-06-30", 2), _fact("2024-07-01", "2024-09-30", 4), _fact("2024-10-01", "2024-12-31", 8)]
    assert ttm(quarters) == [(15.0, "2024-12-31")] and ttm(quarters[:3]) == []
    nine = _fact("2023-01-01", "2023-09-30", 70)
    q = co.latest_quarter(_facts(spark, [year, nine, *quarters[:3], _fact("2022-10-01", "2022-12-31", 20)]), ["c", "metric"]).first()
    assert (q.quarter, str(q.quarter_end), q.before) == (4.0, "2024-09-30", None)
    q = co.latest_quarter(_facts(spark, [year, nine, _fact("2022-10-01", "2022-12-31", 20)]), ["c", "metric"]).first()
    assert (q.quarter, str(q.quarter_end), q.before) == (30.0, "2023-12-31", 20.0)


def test_figures_drop_what_is_no_longer_reported(spark):
    rows = [_fact("2020-01-01", "2020-12-31", 5, metric="net_income"), _fact("2023-01-01", "2023-12-31", 100), _fact("2023-01-01", "2023-12-31", 25, metric="operating_income")]
    got = {r.metric: (r.ttm, r.margin) for r in co.figures(_facts(spark, rows), "c").collect()}
    assert got == {"revenue": (100.0, None), "operating_income": (25.0, 0.25)}


def test_exposure_looks_through_funds(spark):
    positions = spark.createDataFrame(
        [("a", "S", "Stock", "US1234567890", 100.0, None, None), ("a", "E", "Fund", "IE0", 200.0, "F", None), ("a", "G", "Gold note", "IE1", 50.0, "X", "Gold"), ("a", "U", "New fund", "IE2", 30.0, "N", None), ("a", "Z", "None", "DE0", 0.0, None, None), ("a", "P", "Plain", None, 10.0, None, None)],
        "account_id string, ticker string, name string, isin string, value double, fund string, asset string",
    )
    facts = spark.createDataFrame([("S", "US", "Technology")], "ticker string, country string, sector string")
    holdings = spark.createDataFrame([("F", "123456789", "STOCK INC", 40.0, "Technology"), ("F", "o", "Other", 10.0, None), ("F", "n", "Short", -1.0, None)], "fund string, key string, name string, pct double, sector string")
    countries = spark.createDataFrame([("F", "US", 75.0), ("F", "DE", 25.0)], "fund string, country string, pct double")
    e = co.exposure(positions, facts, holdings, countries, spark.createDataFrame([("a", 10.0)], "account_id string, eur double"))
    got = {r.key: (r.name, r.direct, r.total, r.other, r.warned) for r in e.companies().collect()}
    assert got == {
        "123456789": ("Stock", 100.0, 180.0, False, True), "o": ("Other", 0.0, 20.0, False, False), "other:E": ("Other holdings of Fund", 0.0, 100.0, True, False), "asset:Gold": ("Gold", 50.0, 50.0, False, True),
        "fund:U": ("New fund (holdings not loaded yet)", 30.0, 30.0, True, False), "P": ("Plain", 10.0, 10.0, False, False), "cash": ("Cash", 10.0, 10.0, True, False),
    }
    assert {r.country: r.eur for r in e.by_country().collect()} == {"US": 250.0, "DE": 50.0, "Commodity": 50.0, "Unknown": 30.0, "Cash": 10.0, "??": 10.0}
    assert {r.sector: r.eur for r in e.sectors().collect()} == {"Technology": 180.0, "Commodities": 50.0, "Cash": 10.0, "Unclassified": 160.0}


def test_factor_files(spark):
    def archive(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("f.csv", text)
        return out.getvalue()

    text = "About, this\r\n\r\n,Mkt-RF,RF\r\nnote\r\n20240102,  1.50, 0.01\r\n20240103,-99.99,0.01\r\n\r\n2024,9,9\r\n20240104,1,1\r\n"
    rows = raw.factor_rows(spark.createDataFrame([("x", archive(text))], "k string, body binary"), "body").collect()
    assert sorted((str(r.as_of), r.factor, round(r.value, 9)) for r in rows) == [("2024-01-02", "Mkt-RF", 0.015), ("2024-01-02", "RF", 0.0001), ("2024-01-03", "RF", 0.0001)]
    with pytest.raises(Exception, match="no factor file"):
        raw.factor_rows(spark.createDataFrame([("x", archive("no table"))], "k string, body binary"), "body").collect()


def test_fund_reports_merge_by_issuer(spark):
    item = lambda name, lei, cusip, pct, country: f"<invstOrSec><name>{name}</name><lei>{lei}</lei><cusip>{cusip}</cusip><pctVal>{pct}</pctVal><invCountry>{country}</invCountry></invstOrSec>"
    body = '<edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><formData><genInfo><repPdDate>2024-03-31</repPdDate></genInfo><invstOrSecs>' + item("A", "L1", "000000000", 1, "US") + item("A2", "L1", "1", 2.5, "US") + item("B", "", "000000000", 3, "") + item("C", "", "77", "bad", "DE") + "</invstOrSecs></formData></edgarSubmission>"
    reports = spark.createDataFrame([("f", body), ("g", "no xml"), ("h", None)], "fund string, body string")
    rows = raw.fund_holdings(reports, "body", 2).orderBy("rank").collect()
    assert [(r.fund, r.issuer, r.name, r.cusip, r.pct) for r in rows] == [("f", "L1", "A", None, 3.5), ("f", "B", "B", None, 3.0)]
    assert {r.country: (r.pct, r.holdings) for r in raw.fund_countries(reports, "body").collect()} == {"US": (3.5, 2), "Other": (3.0, 1), "DE": (0.0, 1)}


def test_symbols_and_messages(spark):
    rows = spark.createDataFrame([("VUAG.L",), ("MU",), ("BRK-B",), ("A.ZZ",), (".L",)], "s string").select("s", rq.provider_symbols(F.col("s")).alias("p")).collect()
    assert [tuple(r.p) for r in rows] == [("VUAG", "LSE", "VUAG.LON", "VUAG.LSE"), ("MU", None, "MU", "MU.US"), ("BRK-B", None, "BRK-B", "BRK-B.US"), ("A.ZZ", None, "A.ZZ", None), (".L", None, ".L", ".L.US")]
