"""Feeds, instruments, laid-out tables, messages and the calendar: cases worked by hand."""

import uuid
from datetime import date, datetime, timedelta
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import agenda as ag
from ledgerwell.operators import feeds as fd
from ledgerwell.operators import instruments as ins
from ledgerwell.operators import messages as ms
from ledgerwell.sources import scans, tables

FEED = "feed_key string, provider string, url string, template string, tickers array<string>, isins array<string>, trust int"
TARGET = "ticker string, symbol string, isin string, name string, position int"
TARGETS = [("AAPL_US_EQ", "AAPL", "US0378331005", "Apple & Co/É~*+", 1), ("VUAGl_EQ", None, "IE00BFMXXD54", "", 2), ("OLD_EQ", "AAPL", "US0378331005", "Old", 3)]


def feed(key, url=None, template=None, tickers=(), isins=(), provider="rss", trust=50):
    return key, provider, url, template, list(tickers), list(isins), trust


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, TARGET)


@pytest.mark.parametrize("few", [10_000, 0])
def test_templates_are_filled_in(spark, targets, monkeypatch, few):
    monkeypatch.setattr(fd, "FEW_FEEDS", few)
    feeds = [
        feed("all", template="https://x/{yahoo_ticker}"), feed("one", template="https://x/{isin}/{ticker}", tickers=["VUAGl_EQ", "nobody"]), feed("names", template="https://x/?q={name}"),
        feed("none", template="https://x/{ticker}", tickers=["nobody"]), feed("fixed", url="https://f", tickers=["AAPL_US_EQ"], isins=["other"]), feed("several", url="https://g", tickers=["a", "b"], isins=["i"]), feed("market", url="https://m", isins=["only"]),
    ]
    requests, notes = fd.plan(spark.createDataFrame(feeds, FEED), targets)
    got = {(r["feed_key"], r["url"], r["ticker"], r["isin"]) for r in requests.collect()}
    assert got == {
        ("all", "https://x/AAPL", "AAPL_US_EQ", "US0378331005"), ("all", "https://x/AAPL", "OLD_EQ", "US0378331005"), ("one", "https://x/IE00BFMXXD54/VUAGl_EQ", "VUAGl_EQ", "IE00BFMXXD54"),
        ("names", f"https://x/?q={quote(TARGETS[0][3], safe='')}", "AAPL_US_EQ", "US0378331005"), ("names", "https://x/?q=Old", "OLD_EQ", "US0378331005"),
        ("fixed", "https://f", "AAPL_US_EQ", "US0378331005"), ("several", "https://g", None, "i"), ("market", "https://m", None, "only"),
    }
    assert {(r["feed_key"], r["ticker"]) for r in notes.collect()} == {("all", "VUAGl_EQ"), ("names", "VUAGl_EQ"), ("several", None), ("none", None)}


RSS = "<rss><channel><item><title>{}</title><link>{}</link><pubDate>Wed, 01 May 2024 12:00:00 GMT</pubDate></item></channel></rss>"


def test_stored_bodies_find_their_instrument_again(spark, targets):
    feeds = spark.createDataFrame([feed("t", template="https://x/{yahoo_ticker}/rss"), feed("n", template="https://x/{name}"), feed("two", template="https://x/{ticker}-{isin}", trust=90), feed("fixed", url="https://f"), feed("odd", url="https://o", provider="gone"), feed("plain", provider="service")], FEED)
    rows = [
        (1, "t", "https://x/AAPL/rss", RSS.format("Apple beats", "https://a/1")), (2, "t", "https://x/MSFT/rss", "x"), (3, "removed", "https://x", "x"), (4, "odd", "https://o", "x"),
        (5, "n", f"https://x/{quote(TARGETS[0][3], safe='')}", RSS.format("Other story", "https://a/2")), (6, "two", "https://x/VUAGl_EQ-IE00BFMXXD54", RSS.format("Apple  Beats!", "https://b/9")),
        (7, "fixed", "https://anything", "no xml"), (8, "plain", "https://s", '{"data": [{"title": "Market", "url": "https://s/1", "description": "d"}]}'), (9, "t", None, "x"), (10, "t", "https://x/rss", "x"),
    ]
    raw = spark.createDataFrame(rows, "raw_id int, feed_key string, url string, body string")
    known = {r["raw_id"]: (r["ticker"], r["skip"]) for r in fd.attributed(raw, feeds, targets, tuple(fd.READERS)).collect()}
    assert known[1] == ("OLD_EQ", None) and known[5] == ("AAPL_US_EQ", None) and known[6] == ("VUAGl_EQ", None) and known[7] == (None, None) and known[8] == (None, None)
    assert known[2][1] == known[9][1] == known[10][1] == fd.NO_TARGET and known[3][1] == fd.NO_FEED and known[4][1] == fd.NO_READER + "gone'"
    items, skipped = fd.reparsed(raw, feeds, targets)
    items = items.select("dedupe_key", "ticker", "headline")
    assert {(r["ticker"], r["headline"]) for r in items.collect()} == {("AAPL_US_EQ", "Other story"), ("VUAGl_EQ", "Apple  Beats!"), (None, "Market")}
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {fd.NO_TARGET: 3, fd.NO_FEED: 1, fd.NO_READER + "gone'": 1}
    once = tables.insert_new(items.limit(0), items, "dedupe_key")
    again = tables.insert_new(once, fd.reparsed(raw, feeds, targets)[0].select(*once.columns), "dedupe_key")
    assert sorted(again.collect()) == sorted(once.collect()) and once.count() == 3


def test_addresses_are_traced_without_broadcasting_targets(spark):
    feeds = spark.createDataFrame([("t", "rss", None, "https://x/{ticker}", [], [], 1), ("two", "rss", None, "https://x/{ticker}/{isin}", [], [], 1), ("none", "rss", None, "https://x/{name}", [], [], 1)], FEED)
    rows = [(i, k, u) for i, (k, u) in enumerate([("t", "https://x/AAPL_US_EQ"), ("t", "https://y"), ("two", "https://x/OLD_EQ/US0378331005"), ("gone", "https://x/AAPL_US_EQ"), ("none", "https://x/"), ("t", "https://x/")])]
    out = fd.attributed(spark.createDataFrame(rows, "raw_id int, feed_key string, url string"), feeds, spark.createDataFrame(TARGETS, TARGET), ("rss",))
    assert {r["raw_id"]: r["ticker"] for r in out.collect()} == {0: "AAPL_US_EQ", 1: None, 2: "OLD_EQ", 3: None, 4: None, 5: None}
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [") >= 2


def test_fields_come_from_the_first_source_that_has_them(spark):
    schema = "ticker string, seen int, isin string, name string, currency string, instrument_type string"
    positions = spark.createDataFrame([("A", 2, "", None, "USD", None), ("A", 1, None, "first", None, None), ("A", 3, None, "third", "EUR", None)], schema)
    orders = spark.createDataFrame([("A", 1, "order", "no", "no", None), (None, 1, "x", "x", "x", None), ("B", 1, "i", "", None, None)], schema)
    empty = positions.limit(0)
    seen = ins.observed(positions, orders, empty)
    assert {tuple(r) for r in seen.collect()} == {("A", "order", "first", "USD", None), ("B", "i", None, None, None)}
    meta = spark.createDataFrame([("A", "meta", "meta", None, "STOCK"), ("C", "c", "new", "GBX", "ETF"), ("B", "", None, "EUR", None)], schema.replace("seen int, ", ""))
    cache = spark.createDataFrame([("B", "cache", "cached", "CHF", "FUND")], schema.replace("seen int, ", ""))
    rich = ins.enriched(seen, meta, cache)
    assert {tuple(r) for r in rich.collect()} == {("A", "order", "first", "USD", "STOCK"), ("B", "i", "cached", "EUR", "FUND")}
    answers = spark.createDataFrame([("order", None, [("BRK.B", "UW"), ("BRK.B", "US"), ("X", "LN")])], "isin string, error string, candidates array<struct<ticker:string,exchange:string>>")
    mapping = ins.resolved(rich, spark.createDataFrame([("none", "N")], "isin string, symbol string"), answers)
    got = {r["ticker"]: (r["name"], r["observed"], r["status"], r["symbol"]) for r in ins.seeds(rich, meta, mapping).collect()}
    assert got == {"A": ("meta", True, "resolved", "BRK-B"), "B": (None, True, "unresolved", None), "C": ("new", False, "not_required", None)}


def test_scans_read_only_what_is_asked_for(spark, tmp_path):
    name = f"prices_{uuid.uuid4().hex}"
    rows = spark.range(3000).select(F.concat(F.lit("T"), (F.col("id") % 40).cast("string")).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("price_date"), F.col("id").alias("close"))
    scans.write_daily(rows, name, "ticker", "price_date", str(tmp_path / "p"), buckets=8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    some = scans.between(spark, name, "price_date", "2024-02-20", "2024-03-05")
    assert some.count() == rows.filter("price_date between '2024-02-20' and '2024-03-05'").count() > 0
    text = plan(some)
    assert "month" in text.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(price_date" in text.split("PushedFilters:")[1]
    # plans name the buckets that are read only where the scan keeps them apart
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = scans.of_keys(spark, name, "ticker", "T7")
        assert one.count() == 75 and "SelectedBucketsCount: 1 out of 8" in plan(one)
        joined = spark.table(name).groupBy("ticker").agg(F.max("close").alias("m")).join(spark.table(name).select("ticker", "price_date"), "ticker")
        assert "Exchange" not in plan(joined) and joined.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql(f"drop table {name}")


NOW = datetime(2024, 1, 20, 12)


def test_weekly_and_daily_messages(spark):
    at = lambda days: NOW - timedelta(days=days)
    results = spark.createDataFrame([(1, t, v) for t, v in (("A", 5.0), ("B", -9.0), ("C", 9.0), ("D", None), ("E", 1.0), ("F", 2.0), ("G", 3.0), ("H", 4.0))] + [(2, "A", -1.0), (3, "A", None)], "account_id int, ticker string, result double")
    assert [(r["rank"], r["ticker"]) for r in ms.top_movers(results).orderBy("account_id", "rank").collect()] == [(1, "B"), (2, "C"), (3, "A"), (4, "H"), (5, "G"), (6, "F"), (1, "A")]
    news = spark.createDataFrame([("A", at(d), f"h{i}", "s", i) for i, d in enumerate((8, 1, 2, 7, 3, 4))] + [(None, at(1), "x", "s", 9), ("B", None, "y", "s", 9)], "ticker string, ts timestamp, headline string, source string, place int")
    assert [r["headline"] for r in ms.stories(news, F.lit(NOW)).orderBy("rank").collect()] == ["h1", "h2", "h3"]
    card = "account_id int, row_id string, ts timestamp, action string, total double, merchant string, category string"
    cards = spark.createDataFrame([(1, "a", at(1), "Card debit", -10.0, "m", "c"), (1, "b", at(7), "card debit", -2.0, None, ""), (1, "c", at(8), "Card debit", -4.0, "m", "c"), (1, "d", at(1), "Spending cashback", 3.0, "m", "c"), (1, "e", at(0), "Card debit", -99.0, "m", "c"), (1, "f", at(1), "Card debit", None, "m", "c"), (2, "g", at(20), "Card debit", -1.0, "m", "c")], card)
    assert {tuple(r) for r in ms.card_spending(cards, F.lit(NOW)).collect()} == {(1, 12.0, 4.0), (2, 0.0, 0.0)}
    assert {tuple(r) for r in ms.top_merchants(cards, F.lit(NOW)).collect()} == {(1, 1, "m", 10.0), (1, 2, "Unknown", 2.0)}
    budgets = spark.createDataFrame([(1, "c", 50.0), (1, "UNCATEGORISED", 5.0), (1, "none", 7.0)], "account_id int, category string, monthly_limit double")
    assert {r["category"]: r["spent"] for r in ms.budgets_this_month(cards, budgets, F.lit(NOW)).collect()} == {"c": 113.0, "UNCATEGORISED": 2.0, "none": 0.0}
    moves = spark.createDataFrame([(1, "a", at(1), "WITHDRAW", -10.0), (1, "z", at(0.2), "withdrawal", -7.0), (1, "y", at(0.1), "DEPOSIT", 9.0), (4, "x", at(0.1), "WITHDRAW", -1.5)], "account_id int, reference string, ts timestamp, transaction_type string, amount double")
    told = spark.createDataFrame([(1, at(0.1)), (1, at(1)), (5, at(0.2)), (5, None)], "account_id int, ts timestamp")
    facts = {r["account_id"]: tuple(r)[1:] for r in ms.daily_facts(results, cards, moves, told, F.lit(NOW.replace(hour=0))).collect()}
    assert facts == {1: ("C", 9.0, "B", -9.0, 106.0, 2, 1), 2: ("A", -1.0, "A", -1.0, 0.0, 0, 0), 4: (None, None, None, None, 1.5, 1, 0), 5: (None, None, None, None, 0.0, 0, 1)}
    alerts = spark.createDataFrame([(1, "new", at(2)), (1, "old", at(9))], "account_id int, title string, created_at timestamp")
    parts = [r["part"] for r in ms.weekly_payload(results, news, cards, budgets, alerts, F.lit(NOW)).filter("account_id = 1").collect()]
    assert {p: parts.count(p) for p in set(parts)} == {"mover": 6, "story": 3, "spending": 2, "merchant": 2, "budget": 3, "alert": 1}


def test_calendar_and_rhythm(spark):
    today = F.lit(date(2024, 5, 15))  # a Wednesday
    positions = spark.createDataFrame([(1, 1, "OLD"), (1, 2, "A"), (2, 1, "B")], "account_id int, ts int, ticker string")
    watch = spark.createDataFrame([(1, "W"), (1, "A")], "account_id int, ticker string")
    follow = ag.followed(positions, watch)
    assert {tuple(r) for r in follow.collect()} == {(1, "A"), (1, "W"), (2, "B")}
    day = lambda n: date(2024, 5, 15) + timedelta(days=n)
    declared = spark.createDataFrame([("A", day(0), day(9), 1.0), ("A", day(4), None, 2.0), ("W", day(5), None, 1.0), ("OLD", day(1), None, 1.0), ("B", None, day(3), 1.0)], "ticker string, ex_date date, payment_date date, amount double")
    earnings = spark.createDataFrame([("A", day(-62)), ("A", day(-63)), ("W", day(11)), ("W", day(12)), ("B", day(60))], "ticker string, report_date date")
    events = ag.calendar_events(follow, declared, earnings, today, 62)
    assert events.count() == 7 and ag.of_kind(events, "earnings").count() == 4 and ag.of_kind(events, "dividends").count() == 3 and ag.of_kind(events, "all").count() == 7
    groups = {(r["ticker"], r["day"]): (r["group"], r["place"]) for r in ag.agenda(events, today).collect()}
    assert groups == {("A", day(0)): ("today", 1), ("A", day(4)): ("week", 1), ("W", day(5)): ("next", 1), ("W", day(11)): ("next", 2), ("W", day(12)): ("2024-05", 1), ("B", day(60)): ("2024-07", 1)}
    own = spark.createDataFrame([("A", NOW, 9.0), ("H", NOW, 1.0), ("H", NOW + timedelta(days=91), None), ("H", NOW + timedelta(days=182), 3.0), ("N", None, 5.0)], "ticker string, paid_on timestamp, per_share double")
    got = {r["ticker"]: tuple(r)[1:] for r in ag.rhythm(own, declared.filter("ticker <> 'B'")).collect()}
    assert got == {"A": ("declared", None, 2.0, 2), "W": ("declared", None, 1.0, 1), "OLD": ("declared", None, 1.0, 1), "H": ("history", 4, 3.0, 2), "N": ("none", None, None, 0)}
    keys = spark.createDataFrame([("2024-05-15",), ("2024-05",), ("15.5.2024",), (None,), ("2024-13-01",)], "k string").select(*[ag.bucket_key(F.col("k"), u) for u in ("day", "week", "month")]).collect()
    assert [tuple(r) for r in keys] == [("2024-05-15", "2024-05-13", "2024-05"), ("2024-05-01", "2024-04-29", "2024-05"), *[(None,) * 3] * 3]
    pending = ag.pending_rows(spark.createDataFrame([(1, "r", NOW, -3.0, "EUR")], "account_id int, reference string, ts timestamp, amount double, currency string")).first()
    assert (pending["row_id"], pending["action"], pending["category"]) == ("pending-r", "Pending", "PENDING_EXPORT")


def test_repeated_declarations_are_one_before_the_join(spark):
    follow = spark.createDataFrame([("a1", "A"), ("a2", "A")], "account_id string, ticker string")
    declared = spark.createDataFrame([("A", date(2024, 5, 3))] * 50, "ticker string, ex_date date")
    earnings = spark.createDataFrame([("A", date(2024, 5, 4))] * 50, "ticker string, report_date date")
    got = ag.calendar_events(follow, declared, earnings, F.lit("2024-05-01").cast("date"), 62)
    assert got.count() == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("Aggregate")  # no rows to tell apart after it


def test_last_amount_of_a_rhythm_needs_an_ex_day(spark):
    own = spark.createDataFrame([], "ticker string, paid_on timestamp, per_share decimal(10,2)")
    rows = [("N", None, date(2024, 5, 3), 7), ("N", None, None, 9), ("M", None, date(2024, 5, 3), 7), ("M", date(2024, 2, 1), None, 3)]
    declared = spark.createDataFrame(rows, "ticker string, ex_date date, payment_date date, amount int")
    assert {r["ticker"]: (r["last_amount"], r["payments"]) for r in ag.rhythm(own, declared).collect()} == {"N": (None, 2), "M": (3, 2)}
